"""Best-fit packing: documents as token ids in as few sequences of a fixed capacity as the linear grouping scheme finds.

Only documents longer than the capacity are cut; full pieces fill a sequence each. How many pieces there
are of each length is all that planning needs: at most `capacity` numbers, whatever the input. The driver plans on them:

1. Large lengths (over `small` of the capacity) are cut, by rank, into groups of equal cardinality, and each is rounded
   up to the largest length of its group, so few sizes are left.
2. Configurations, multisets of these sizes that fit a sequence, are found by column generation: a simplex over the
   groups, priced by a knapsack over the capacity. Whole parts of the solution are taken.
3. Actual documents take the places of the rounded sizes, in order of rank, which leaves room behind them.
4. What is left of the large documents, then the small ones, by falling length, best-fit into what room there is.

Sequences that hold the same lengths are planned at once, as a range of numbers, so a plan has rows for lengths and ranges,
not for documents. A document is placed by its number among those of its length: its number in the task that encoded it,
and how many of the length the tasks before it have, a running sum in Spark.

Defined cases: a null or empty text is the end id alone; repeated rows are rows of their own, null doc_ids stay null; an
empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrail.llm.common import materialize, slices, table, utf8, words_of
from veritrail.llm.token_output import Encoder

PIECES = "part int, doc_id long, piece int, start long, length int, nth long, ids_crc32 long, ids binary"
PIECES_ARROW = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("nth", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
RUNS = "length int, lo long, hi long, first long, each int, at int"
CAPACITY = 2048
#: (groups, small) that a plan tries. Few groups leave much room behind their documents, which only many small ones can fill; many groups
#: leave little, but some of it is smaller than any document.
SCHEMES = ((8, 0.34), (8, 0.5), (6, 0.4), (8, 0.25), (16, 0.5), (32, 0.25))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder(Encoder):
    """Ids of texts for a vocabulary that drops white space: each word is encoded by itself, and once."""

    keep = 1_500_000  # some 40 bytes each: to encode a word anew costs more than all else

    def __init__(self, path: str):
        super().__init__(path)
        self.closes = np.zeros(self.size, bool)  # ids that end a word of the tokenizer
        for token, i in self.tokenizer.get_vocab().items():
            self.closes[i] = token.endswith("</w>")
        kind = np.full(256, 3, np.uint8)  # letters 0, digits 1, signs 2; 3: left to the library as it stands
        kind[33:127] = 2
        kind[48:58] = 1
        kind[65:91] = kind[97:123] = 0
        kind[[39, 60]] = 3  # shortened words, special tokens
        self.kind = kind

    def _pieces(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return words_of(raw, off)[:2]

    def _encode(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number for each word). Words of letters, digits and signs alone are encoded many in one text: the tokenizer's
        own cuts in them are known (a stretch of letters or of signs, each digit), so ids are told apart by the ends of those."""
        kind = self.kind[raw]
        odd = np.concatenate(([0], np.cumsum(kind == 3)))
        cut = np.ones(len(raw), np.int64)
        cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 1)
        cuts = np.concatenate(([0], np.cumsum(cut)))
        plain = odd[end] == odd[start]
        a, b = np.flatnonzero(plain), np.flatnonzero(~plain)
        parts = cuts[end[a]] - cuts[start[a]] + 1 - cut[start[a]]  # the first byte always begins a part
        size = end[a] - start[a] + 1
        to = np.concatenate(([0], np.cumsum(size)))
        joined = np.full(int(to[-1]), 32, np.uint8)
        src = np.arange(int(to[-1])) + np.repeat(start[a] - to[:-1], size)
        inside = np.ones(len(joined), bool)
        inside[to[1:] - 1] = False
        joined[inside] = raw[src[inside]]
        ids_a, _ = self._flat([joined[x:y].tobytes().decode() for x, y in self._blocks(to)])
        last = np.flatnonzero(self.closes[ids_a])
        data = raw.tobytes()
        if len(last) != parts.sum():
            ids_a, n_a = self._flat([data[s:e].decode() for s, e in zip(start[a].tolist(), end[a].tolist())])
        else:
            n_a = np.diff(np.concatenate(([-1], last[np.cumsum(parts) - 1]))) if len(a) else np.zeros(0, np.int64)
        ids_b, n_b = self._flat([data[s:e].decode() for s, e in zip(start[b].tolist(), end[b].tolist())])
        return self._in_order(len(start), (a, ids_a, n_a), (b, ids_b, n_b))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def cutter(vocabulary: str, end: int, capacity: int):
    def run(batches):
        from pyspark import TaskContext

        part, coder = TaskContext.get().partitionId(), encoder(vocabulary)
        seen = np.zeros(capacity + 1, np.int64)  # pieces of each length so far
        for batch in batches:
            raw, off = utf8(batch["text"])
            doc_ids = batch["doc_id"]
            for lo, hi in slices(off, 4 << 20):
                ids, counts = coder.encode(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], end)
                n = -(-counts // capacity)
                row = np.repeat(np.arange(hi - lo), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(counts[row] - start, capacity)
                by = np.argsort(length, kind="stable")
                sorted_ = length[by]
                nth = np.empty(len(by), np.int64)
                nth[by] = np.arange(len(by)) - np.searchsorted(sorted_, sorted_) + seen[sorted_]
                seen += np.bincount(length, minlength=capacity + 1)
                flat = ids.astype("<u4").tobytes()
                cut = np.concatenate(([0], np.cumsum(length))) * 4
                crc = [zlib.crc32(memoryview(flat)[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
                blobs = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(cut.astype(np.int32).tobytes()), pa.py_buffer(flat)])
                whose = doc_ids.slice(lo, hi - lo).take(pa.array(row))
                columns = [pa.array(np.full(len(row), part), pa.int32()), whose, pa.array(piece, pa.int32()), pa.array(start), pa.array(length, pa.int32()), pa.array(nth), pa.array(crc, pa.int64()), blobs]
                yield pa.RecordBatch.from_arrays(columns, schema=PIECES_ARROW)

    return run


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end: int = 0) -> DataFrame:
    """Written: a row for each piece of each document: its ids (little-endian unsigned 32-bit), start, length, and nth among those of its length and part."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(own.mapInArrow(cutter(vocabulary or default_vocabulary(), end, capacity), PIECES), "pieces")


# planning, on numbers of pieces by length


def linear_groups(large: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """(length, pieces) by falling length, cut by rank into groups of equal cardinality. Groups of one length alone are joined."""
    total = sum(n for _, n in large)
    most = max(1, -(-total // groups))
    out: list[list[tuple[int, int]]] = []
    room = 0
    for length, n in large:
        while n:
            if not room:
                room = most
                if not (out and out[-1][0][0] == length):  # else its rounded size is the same
                    out.append([])
            take = min(n, room)
            if out[-1] and out[-1][-1][0] == length:
                out[-1][-1] = (length, out[-1][-1][1] + take)
            else:
                out[-1].append((length, take))
            n -= take
            room -= take
    return out


def best_configuration(worth: np.ndarray, sizes: list[int], capacity: int) -> np.ndarray:
    """How often each size stands in the configuration of most worth: a knapsack over the capacity."""
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    own = np.array(sizes)
    for room in range(int(own.min()), capacity + 1):
        gain = np.where(own <= room, value[np.maximum(room - own, 0)] + worth, 0.0)
        best = int(gain.argmax())
        value[room], choice[room] = (gain[best], best) if gain[best] > value[room - 1] else (value[room - 1], -2)
    counts, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0 and choice[room] != -1:
        if choice[room] == -2:
            room -= 1
        else:
            counts[choice[room]] += 1
            room -= sizes[choice[room]]
    return counts


def configurations(sizes: list[int], needed: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """(how often each size stands, sequences): whole parts of the cheapest mix of configurations that covers `needed`."""
    if not sizes:
        return []
    basis = np.diag([float(capacity // s) for s in sizes])
    amount = np.array(needed, float)
    for _ in range(20 * len(sizes)):
        inverse = np.linalg.inv(basis)
        worth = inverse.sum(axis=0)  # what one more piece of each size costs
        new = best_configuration(np.maximum(worth, 0), sizes, capacity).astype(float)
        if new @ worth <= 1 + 1e-7:
            break
        direction, held = inverse @ new, inverse @ amount
        rising = direction > 1e-9
        ratio = np.full(len(sizes), np.inf)
        ratio[rising] = np.maximum(held[rising], 0) / direction[rising]
        basis[:, int(ratio.argmin())] = new
    held = np.linalg.solve(basis, amount)
    return [(basis[:, i].astype(np.int64), int(held[i] + 1e-6)) for i in range(len(sizes)) if held[i] + 1e-6 >= 1]


class Room:
    """Ranges of sequences by the room left in them. All sequences of a range hold the same lengths."""

    def __init__(self, capacity: int):
        self.capacity, self.ranges, self.opened, self.runs = capacity, defaultdict(list), 0, []
        self.taken: dict[int, int] = defaultdict(int)  # of each length, pieces that have a place

    def add(self, first: int, n: int, left: int) -> None:
        if n and left:
            self.ranges[left].append((first, n))

    def _put(self, length: int, pieces: int, first: int, each: int, at: int) -> None:
        lo = self.taken[length]
        self.runs.append((length, lo, lo + pieces, first, each, at))
        self.taken[length] = lo + pieces

    def _deal(self, length: int, pieces: int, first: int, n: int, left: int) -> int:
        """Best fit of equal lengths into n sequences of one range: the tightest one stays so until it holds no more of them. Returns what is left over."""
        each = left // length
        full = min(n, pieces // each)
        at = self.capacity - left
        if full:
            self._put(length, full * each, first, each, at)
            self.add(first, full, left - each * length)
        pieces -= full * each
        if pieces and full < n:  # the last takes what remains
            self._put(length, pieces, first + full, pieces, at)
            self.add(first + full, 1, left - pieces * length)
            pieces, full = 0, full + 1
        self.add(first + full, n - full, left)
        return pieces

    def best_fit(self, length: int, pieces: int) -> None:
        for left in sorted(k for k, v in self.ranges.items() if k >= length and v):
            own, self.ranges[left] = self.ranges[left], []
            for k, (first, n) in enumerate(own):
                if not pieces:
                    self.ranges[left] += own[k:]
                    break
                pieces = self._deal(length, pieces, first, n, left)
            if not pieces:
                return
        if pieces:
            n = -(-pieces // (self.capacity // length))
            first, self.opened = self.opened, self.opened + n
            self._deal(length, pieces, first, n, self.capacity)

    def substitute(self, config: np.ndarray, n: int, members: list[list[list[int]]]) -> None:
        """Open n sequences of a configuration and put actual pieces in its places: each place takes the next n of its group, as far as there are."""
        first, self.opened = self.opened, self.opened + n
        places = [g for g, times in enumerate(config.tolist()) for _ in range(times)]
        filled = []  # of each place, (length, sequences) in order
        for g in places:
            own, want = [], n
            while want and members[g]:
                take = min(want, members[g][0][1])
                own.append((members[g][0][0], take))
                want -= take
                members[g][0][1] -= take
                if not members[g][0][1]:
                    members[g].pop(0)
            filled.append((own, n - want))
        cuts = sorted({0, n, *(int(c) for own, _ in filled for c in np.cumsum([k for _, k in own]))})
        for a, b in zip(cuts[:-1], cuts[1:]):
            at = 0
            for own, upto in filled:
                if a >= upto:
                    continue
                length = next(x for (x, _), c in zip(own, np.cumsum([k for _, k in own])) if a < c)
                self._put(length, b - a, first + a, 1, at)
                at += length
            self.add(first + a, b - a, self.capacity - at)


def planned(falling: list[tuple[int, int]], capacity: int, groups: int, small: float) -> Room:
    room = Room(capacity)
    large = linear_groups([(length, n) for length, n in falling if length > small * capacity], groups)
    members = [[list(m) for m in own] for own in large]
    for config, n in configurations([own[0][0] for own in large], [sum(n for _, n in own) for own in large], capacity):
        room.substitute(config, n, members)
    rest: dict[int, int] = defaultdict(int)
    for length, n in [(length, n) for own in members for length, n in own] + [(length, n) for length, n in falling if length <= small * capacity]:
        rest[length] += n
    for length, n in sorted(rest.items(), reverse=True):
        room.best_fit(length, n)
    return room


def plan(pieces: dict[int, int], capacity: int = CAPACITY, schemes: tuple[tuple[int, float], ...] = SCHEMES) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """(runs, sequences). A run (length, lo, hi, first, each, at): of the pieces of a length, those numbered lo to hi stand `each` in a sequence from number `first` on, from place `at`.

    The fewest sequences of several schemes (groups, small), or the first that needs no more than the tokens fill.
    """
    falling = sorted(((length, n) for length, n in pieces.items() if n), reverse=True)
    least = -(-sum(length * n for length, n in falling) // capacity)
    best = None
    for groups, small in schemes:
        room = planned(falling, capacity, groups, small)
        if best is None or room.opened < best.opened:
            best = room
        if best.opened == least:
            break
    return best.runs, best.opened


def pack(pieces: DataFrame, capacity: int = CAPACITY, schemes: tuple[tuple[int, float], ...] = SCHEMES) -> DataFrame:
    """All columns of pieces_of but part and nth, with sequence_id and offset. Runs are broadcast: their number is bounded by lengths and
    configurations (under capacity * small for each of some capacity + 2 * groups ranges), whatever the input."""
    spark = pieces.sparkSession
    counts = materialize(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs, _ = plan(total, capacity, schemes)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")  # a row for each part
    starts = counts.select("part", "length", before.alias("before"))
    numbered = pieces.join(starts, ["part", "length"]).withColumn("nth", F.col("nth") + F.col("before")).drop("part", "before")
    runs = spark.createDataFrame(runs, RUNS)
    inside = (F.col("p.length") == F.col("r.length")) & (F.col("nth") >= F.col("lo")) & (F.col("nth") < F.col("hi"))
    placed = numbered.alias("p").join(F.broadcast(runs).alias("r"), inside)
    place = F.col("nth") - F.col("lo")
    sequence = F.col("first") + F.floor(place / F.col("each"))
    return placed.select("p.*", sequence.cast("long").alias("sequence_id"), (F.col("at") + (place % F.col("each")) * F.col("p.length")).cast("long").alias("offset")).drop("nth")


def op12_packing(spark, sf_dir: str) -> DataFrame:
    out = pack(pieces_of(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
