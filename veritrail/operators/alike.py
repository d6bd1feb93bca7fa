"""Pairs of titles that are at least 90 % alike by the Indel ratio, without loss.

Short titles meet by segments: such titles differ by at most `edits` single insertions and deletions, so of edits + 1 + k
segments of the shorter one at least k + 1 stand unchanged in the longer one, and any k may be left out: those are left out whose text
many titles share (a common word). How many segments a title of some length has, and which are left out, is planned on
at most SAMPLE titles of each length; the plan changes the work alone, not what is found. A key is a segment's text, its number, the
shorter title's length and the block; keys are made with numpy and met by a join of Spark's, which compares counts of letters, then
Spark's levenshtein with a limit.

A segment has some four characters however long the title is, and prose holds each of them often. Longer titles are
therefore compared in tiles: chunks of titles of one block and of near lengths, each met by each; counts of letters, of whole titles and of
their halves, refuse most pairs, the others are scored, many side by side as one number, as far as they may still be alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.functions import similarity
from veritrail.operators.folds import dealt, folded
from veritrail.plans.session import written

#: Titles that are at least this much alike are candidates.
ALIKE = 90
#: Pairs whose shorter title has at most this many characters meet by segments, the others in tiles.
SHORT = 48
#: Titles and characters of a chunk of a tile, at most.
CHUNK, CHUNK_LETTERS = 4000, 1 << 22
#: Chunks of a band that there are at least, unless they have fewer titles than FEW.
CHUNKS, FEW = 4, 500
#: Titles of a length that its plan is made on, and segments that a plan may leave out.
SAMPLE, LEFT_OUT = 2000, 6
#: Where titles are cut for the test of halves, in percent: what stands opposite the middle of a title that is ALIKE lies between 38.8 and 61.2.
CUTS = tuple(range(36, 65, 2))
#: From so many titles on, scores of one title are found side by side, at most so many at once.
MANY, BESIDE = 4, 256

U64 = np.uint64
#: Groups of characters that are counted: 32, rare letters together. Any other character goes by its number.
GROUPS = np.arange(128, dtype=np.int64) & 31
for _i, _group in enumerate([*"0123456789", *"acdefghilmnoprstu", "bv", "jq", "kw", "xz", "y "]):
    GROUPS[[ord(c) for c in _group]] = _i
_BASE = 0x9E3779B97F4A7C55
_POWERS = np.array([pow(_BASE, i, 2**64) for i in range(2 * SHORT)], U64)
_INVERSES = np.array([pow(_BASE, -i, 2**64) for i in range(2 * SHORT)], U64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def limit_of(least: float, characters: int) -> int:
    """Edits that two titles of so many characters together may differ by."""
    return int((100 - least) * characters / 100 + 1e-9)


def segments(n: int, parts: int) -> tuple[list[int], list[int]]:
    """(places, sizes) of a title of n characters in so many parts."""
    size, longer = divmod(n, parts)
    sizes = [size] * (parts - longer) + [size + 1] * longer
    return [sum(sizes[:i]) for i in range(parts)], sizes


def most_edits(n: int, least: float) -> int:
    """Edits that a title of n characters and one that is no shorter may differ by."""
    return limit_of(least, int(200 * n / least + 1e-9))


#: Of a length of titles: how many segments they have, and the numbers of those that are compared, the least shared ones first.
Plan = tuple[int, tuple[int, ...]]


def planned(titles: list[str], n: int, least: float) -> Plan:
    """The plan for titles of n characters by which these share the fewest segments."""
    edits = most_edits(n, least)
    best = None
    for k in range(min(LEFT_OUT, n - edits - 1) + 1):
        places, sizes = segments(n, edits + 1 + k)
        shared = []
        for place, size in zip(places, sizes):
            seen: dict[str, int] = {}
            for t in titles:
                seen[t[place : place + size]] = seen.get(t[place : place + size], 0) + 1
            shared.append(sum(c * c for c in seen.values()) - len(titles))
        kept = sorted(range(len(shared)), key=shared.__getitem__)[: edits + 1]
        cost = sum(shared[i] for i in kept)
        if best is None or cost < best[0]:
            best = cost, (edits + 1 + k, tuple(kept))
    return best[1]


def _plans(own: DataFrame, least: float) -> dict[int, Plan]:
    """A plan for each length of short titles: at most SHORT rows."""
    counted = {r["n"]: r["count"] for r in own.groupBy("n").count().collect()}
    if not counted:
        return {}
    share = F.get(F.array(*(F.lit(-(-counted.get(n, 0) // SAMPLE)) for n in range(SHORT + 1))), F.col("n"))
    picked = own.where(F.pmod(F.xxhash64("title"), share) == 0).select("n", "title")
    found = folded(picked, ["n"], [], lambda rows: [(rows[0][0], *planned([r[1] for r in rows], rows[0][0], least))], "n int, parts int, kept array<int>")
    plans = {r["n"]: (r["parts"], tuple(r["kept"])) for r in found.collect()}
    whole = lambda n: most_edits(n, least) + 1
    return {n: plans.get(n, (whole(n), tuple(range(whole(n))))) for n in counted}


def _own_segments(n: int, plans: dict[int, Plan]) -> tuple[np.ndarray, ...]:
    """(salt, start, size) of the compared segments of a title of n characters."""
    parts, kept = plans[n]
    places, sizes = segments(n, parts)
    return np.array([n << 16 | i for i in kept], U64), np.array([places[i] for i in kept]), np.array([sizes[i] for i in kept])


def _places_of_segments(ny: int, plans: dict[int, Plan], least: float) -> tuple[np.ndarray, ...]:
    """(salt, start, size, limit, nx) of all places of a title of ny characters where a segment of an alike one that is no longer may stand.

    Edits of a pair are even or odd as its lengths differ, so there may be one less than the limit; of as many segments as edits
    and one more, any may be taken: the least shared ones. Of these in order there is a first one with no more edits up to its end than segments
    before it. It is unchanged, and has as many edits before it as segments, so it has moved by that number, less two, less four, ...
    """
    out = []
    for nx, (parts, kept) in plans.items():
        more, limit = ny - nx, limit_of(least, nx + ny)
        if nx > ny or more > limit:
            continue
        edits = limit - (limit - more) % 2
        places, sizes = segments(nx, parts)
        for before, i in enumerate(sorted(kept[: edits + 1])):
            place, size = places[i], sizes[i]
            for moved in range(max(-before, more - (edits - before)), min(before, more + edits - before) + 1, 2):
                if 0 <= place + moved <= ny - size:
                    out.append((nx << 16 | i, place + moved, size, limit, nx))
    salt, *rest = np.array(out, np.int64).reshape(-1, 5).T
    return salt.astype(U64), *rest


def letter_counts(codes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """(rows, 32): how often each group of characters stands in each row, from all characters and the rows they stand in."""
    group = np.where(codes < 128, GROUPS[np.minimum(codes, 127)], codes & 31)
    return np.bincount(row * 32 + group, minlength=rows * 32).reshape(rows, 32)


def _letter_maps(codes: np.ndarray) -> np.ndarray:
    """(rows, 4) longs: each count, up to 8, as a run of ones; bits that differ tell how much counts differ by at least."""
    rows = np.repeat(np.arange(len(codes)), codes.shape[1])
    counts = np.minimum(letter_counts(codes.ravel().astype(np.int64), rows, len(codes)), 8)
    return ((1 << counts) - 1).astype(np.uint8).view(np.int64)


def _keys(codes: np.ndarray, block: np.ndarray, salt: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(titles, segments): keys of stretches of titles of one length."""
    m, n = codes.shape
    sums = np.zeros((m, n + 1), U64)
    np.cumsum(_mix(codes.astype(U64) + U64(0x9E3779B97F4A7C15)) * _POWERS[:n], axis=1, out=sums[:, 1:])
    held = _mix((sums[:, start + size] - sums[:, start]) * _INVERSES[start])
    return _mix(held ^ _mix(block[:, None] + salt * U64(0xD6E8FEB86659FD93)))


MAPS = [f"m{k}" for k in range(4)]
INDEX = f"key long, a string, a_lone boolean, {', '.join(f'a_{m} long' for m in MAPS)}"
PROBE = f"key long, b string, b_lone boolean, {', '.join(f'b_{m} long' for m in MAPS)}, most int, equal boolean"


def _keyed(least: float, plans: dict[int, Plan], probe: bool):
    """Rows of titles (title, n, block, lone) by their segments (INDEX), or by the places where those of others may stand (PROBE)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, block = batch["n"].to_numpy(), batch["block"].to_numpy().view(U64)
            for own in np.unique(n).tolist():
                salt, start, size, *more = _places_of_segments(own, plans, least) if probe else _own_segments(own, plans)
                if not len(salt):
                    continue
                every = np.flatnonzero(n == own)
                for at in np.array_split(every, -(-len(every) * len(salt) // 50_000)):
                    if not len(at):
                        continue
                    titles = batch["title"].take(pa.array(at))
                    codes = np.array(titles.to_pylist(), dtype=f"<U{own}").view(np.uint32).reshape(len(at), own)
                    keys = _keys(codes, block[at], salt, start, size).view(np.int64).ravel()
                    row = np.repeat(np.arange(len(at)), len(salt))
                    maps = _letter_maps(codes)[row]
                    columns = [pa.array(keys), titles.take(pa.array(row)), batch["lone"].take(pa.array(at[row])), *(pa.array(np.ascontiguousarray(maps[:, k])) for k in range(4))]
                    names = ["key", "a", "a_lone", *(f"a_{m}" for m in MAPS)]
                    if more:
                        most, nx = (np.tile(c, len(at)) for c in more)
                        columns += [pa.array(most.astype(np.int32)), pa.array(nx == own)]
                        names = ["key", "b", "b_lone", *(f"b_{m}" for m in MAPS), "most", "equal"]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _short_pairs(own: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose shorter title has at most SHORT characters and that may be alike."""
    short = own.where(F.col("n") <= SHORT)
    plans = _plans(short, least)
    longest = int(SHORT * (200 / least - 1) + 1e-9)
    index = dealt(short.select("title", "n", "block", "lone")).mapInArrow(_keyed(least, plans, False), INDEX)
    probe = dealt(own.where(F.col("n") <= longest).select("title", "n", "block", "lone")).mapInArrow(_keyed(least, plans, True), PROBE)
    apart = sum((F.bit_count(F.col(f"a_{m}").bitwiseXOR(F.col(f"b_{m}"))) for m in MAPS), F.lit(0))
    fits = (F.col("a_lone") | F.col("b_lone")) & (apart <= F.col("most")) & (~F.col("equal") | (F.col("a") < F.col("b")))
    fits &= F.expr("levenshtein(a, b, most) >= 0")
    met = dealt(index, "key").hint("shuffle_hash").join(dealt(probe, "key"), "key").where(fits)
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.withColumn("score", similarity.indel_ratio("a", "b")).where(F.col("score") >= least)


def _counted(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How often each group of characters stands in each title (n, title, ...), in its stretches up to CUTS, and in its first half."""
    n = np.array([r[0] for r in rows])
    codes = np.frombuffer("".join(r[1] for r in rows).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), n)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(n) - n, n)
    held = lambda ends: letter_counts(codes[kept], row[kept], len(rows)).T.astype(np.int32) if len(kept := np.flatnonzero(place < np.repeat(ends, n))) else np.zeros((32, len(rows)), np.int32)
    return held(n), np.stack([held(n * cut // 100) for cut in CUTS]), held(n // 2)


def _halves_fit(front: np.ndarray, whole: np.ndarray, places: np.ndarray, other: np.ndarray, n: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Whether titles may be alike to one whose first half and whole have these counts.

    Alike titles may be cut so that the counts of both parts together differ by no more than the limit: the one in its middle, the other
    between the first and the last of CUTS. A cut that moves by a character changes the difference by two at most, so
    between two places it is at least their mean less the way between them.
    """
    apart = np.abs(places - front[:, None]).sum(1) + np.abs((other - places) - (whole - front)[:, None]).sum(1)
    ends = np.stack([n * cut // 100 for cut in CUTS])
    return ((apart[1:] + apart[:-1] - 2 * (ends[1:] - ends[:-1])) <= 2 * limit).any(0)


def _near(mine: list[tuple], others: list[tuple], least: float, same: bool) -> Iterator[tuple]:
    """Alike pairs of rows (n, title, lone), by falling tests: lengths, counts of letters, those of halves, the score. same: others is mine."""
    mine, others = sorted(mine), sorted(others)
    if not mine or not others:
        return

    (own, _, front), (other, places, _) = _counted(mine), _counted(others)
    beside = similarity.Beside([r[1] for r in others])
    n, lone = np.array([r[0] for r in others]), np.array([r[2] for r in others])
    for i, (size, title, own_lone) in enumerate(mine):
        lo = i + 1 if same else int(np.searchsorted(n, int(size * least / (200 - least) - 1e-9)))
        hi = int(np.searchsorted(n, int(size * (200 - least) / least + 1e-9), side="right"))
        if lo >= hi:
            continue
        limit = ((100 - least) * (size + n[lo:hi]) / 100 + 1e-9).astype(np.int64)
        fits = np.abs(other[:, lo:hi] - own[:, i : i + 1]).sum(0) <= limit
        if not own_lone:
            fits &= lone[lo:hi]
        near = lo + np.flatnonzero(fits)
        at = near[_halves_fit(front[:, i], own[:, i], places[:, :, near], other[:, near], n[near], limit[near - lo])]
        if len(at) < MANY:
            known = similarity.letter_places(title)
            scores = [(j, similarity.ratio_within(title, known, others[j][1], least)) for j in at.tolist()]
        else:
            scores = [found for k in range(0, len(at), BESIDE) for found in beside.ratios_within(title, at[k : k + BESIDE], least)]
        for j, score in scores:
            met = others[j][1]
            if score is not None and met != title:
                yield (title, met, score) if title < met else (met, title, score)


def _tile(least: float):
    def fold(rows: list[tuple]) -> Iterator[tuple]:
        if len(rows) < 2:
            return
        *_, first, second = rows[0][:5]
        sides = ([], [])
        for r in rows:
            sides[r[5]].append(r[6:])
        if r[1] == 0 and first == second:
            yield from _near(sides[0], sides[0], least, True)
        else:
            yield from _near(*sides, least, False)

    return fold


def _long_pairs(own: DataFrame, least: float) -> DataFrame:
    """Alike pairs (a, b, score) whose titles both have more than SHORT characters.

    A band is a range of lengths, wide enough that alike titles stand in one band or in neighbouring ones. A band of a
    block is dealt to chunks by hash, and a tile is two chunks of one band (next: 0) or of neighbouring ones (next: 1).
    """
    width = float(np.log((200 - least) / least) + 1e-6)
    banded = own.where(F.col("n") > SHORT).withColumn("band", F.floor(F.log(F.col("n").cast("double")) / width).cast("int"))
    held = F.greatest(F.least(F.count(F.lit(1)) / CHUNKS, F.lit(CHUNK)), F.least(F.lit(FEW), F.lit(CHUNK)))
    sizes = banded.groupBy("block", "band").agg(F.ceil(F.greatest(F.count(F.lit(1)) / held, F.sum("n") / CHUNK_LETTERS)).cast("int").alias("k"))
    sizes = written(sizes)
    up = sizes.select("block", (F.col("band") - 1).alias("band"), F.col("k").alias("k_up"))
    down = sizes.select("block", (F.col("band") + 1).alias("band"), F.col("k").alias("k_down"))
    around = sizes.join(up, ["block", "band"], "left").join(down, ["block", "band"], "left")
    chunked = banded.join(around, ["block", "band"]).withColumn("chunk", F.pmod(F.xxhash64("title"), F.col("k")).cast("int"))
    mine, none = F.col("chunk"), F.array().cast("array<struct<band:int,next:int,first:int,second:int,side:int>>")

    def tile(band, following: int, first, second, side):
        return F.struct(band.cast("int").alias("band"), F.lit(following).alias("next"), first.cast("int").alias("first"), second.cast("int").alias("second"), side.cast("int").alias("side"))

    each = lambda k: F.sequence(F.lit(0), F.col(k) - 1)
    inside = F.transform(each("k"), lambda j: tile(F.col("band"), 0, F.least(mine, j), F.greatest(mine, j), F.when(mine > j, 1).otherwise(0)))
    lower = F.coalesce(F.transform(each("k_up"), lambda j: tile(F.col("band"), 1, mine, j, F.lit(0))), none)
    upper = F.coalesce(F.transform(each("k_down"), lambda j: tile(F.col("band") - 1, 1, j, mine, F.lit(1))), none)
    rows = chunked.select("block", F.explode(F.concat(inside, lower, upper)).alias("t"), "n", "title", "lone").select("block", "t.next", "t.band", "t.first", "t.second", "t.side", "n", "title", "lone")
    return folded(rows, ["block", "next", "band", "first", "second"], [], _tile(least), "a string, b string, score double")


def alike_titles(titles: DataFrame, least: float = ALIKE) -> DataFrame:
    """Pairs (a, b, score) of different sorted titles (column title) with an Indel ratio of at least `least` (90 or more). Lossless.

    With a column block, only pairs that share a block; with a column lone, only pairs of which one at least is lone in that block.
    Work is bounded in memory, but pairs of one block and near length, or that share a segment, are all looked at.
    """
    if least < ALIKE:
        raise ValueError(f"titles less than {ALIKE} % alike need another index")
    block = F.xxhash64("block") if "block" in titles.columns else F.lit(0).cast("long")
    lone = F.col("lone") if "lone" in titles.columns else F.lit(True)
    own = titles.where("title <> ''").select("title", block.alias("block"), lone.alias("lone"))
    own = written(own.groupBy("title", "block").agg(F.bool_or("lone").alias("lone")).withColumn("n", F.length("title")))
    return _short_pairs(own, least).union(_long_pairs(own, least)).distinct()
