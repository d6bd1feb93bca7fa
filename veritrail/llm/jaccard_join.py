"""N-gram Jaccard join with set-relation skipping.

A document's set holds its distinct five-word shingles (hashed to 64 bits); sets link at a
Jaccard similarity of 0.75 or more. All documents are joined with all:

1. An exchange counts in how many documents each shingle stands. A set of which less than
   three quarters stand elsewhere too can link with nothing and is done.
2. Equal sets collapse to the one with the least doc_id.
3. Sets that share a prefix token (rarest first) lie in one coarse group; no link crosses groups.
4. Within a group, blocks of sets are joined with an inverted index whose lists are cut into
   blocks by token position, so that whole list blocks are skipped once their position rules
   out enough overlap. The answers of a set are derived from those of a highly similar set:
   Jaccard distance is a metric, so known distances to that set settle most candidates, and
   candidates already in one component need no look.
5. Groups over a block: blocks find components, a few delegates of each component meet in
   further rounds, then the blocks of sets in different components meet pairwise. No pair of
   different components is left out, and pairs within a component are never listed.

Defined cases: no words or a null text give an empty set linked with nothing (component: itself);
under five words, the whole sequence is one shingle; a null doc_id counts as the smallest and
comes back null; repeated rows have equal sets and share a component; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrail.llm import exchange as X
from veritrail.llm.common import INVERSE, U64, chunk_bounds, materialize, measured, mix, powers, prefix_hash, run_hash, table, utf8, with_chunks, word_hashes, words_of
from veritrail.llm.components import components

SETS = "doc_id long, n_shingles long, h1 long, h2 long, tokens binary, prefix int"
SETS_ARROW = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("tokens", pa.binary()), ("prefix", pa.int32())])
EDGES = "a long, b long"
EDGES_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64())])
SHIFT = 24
LOW = U64((1 << SHIFT) - 1)
UPPER = np.arange(256, dtype=np.uint8)
UPPER[65:91] += 32


def shingle_sets(texts: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every row: (row, hash), ordered by row and hash."""
    raw, off = utf8(texts)
    raw = UPPER[raw]
    starts, ends, first = words_of(raw, off)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    sums = prefix_hash(word_hashes(raw, starts, ends, 5))
    count = np.diff(first)
    last = np.repeat(first[1:], count)
    at = np.flatnonzero(np.arange(len(starts)) + width <= last)
    inverse = powers(INVERSE, len(starts))
    full = run_hash(sums, at, at + width, inverse)
    row = np.repeat(np.arange(len(count)), count)[at]
    few = np.flatnonzero((count > 0) & (count < width))
    if len(few):
        whole = mix(run_hash(sums, first[few], first[few + 1], inverse) ^ (count[few].astype(U64) * U64(0xD6E8FEB86659FD93)))
        full, row = np.concatenate((full, whole)), np.concatenate((row, few))
    by = np.lexsort((full, row))
    full, row = full[by], row[by]
    new = np.concatenate(([True], (full[1:] != full[:-1]) | (row[1:] != row[:-1])))
    return row[new], full[new]


def tallied(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each stands, at most 255."""
    s = np.sort(keys)
    head = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
    return s[head], np.minimum(np.diff(np.concatenate((head, [len(s)]))), 255).astype(np.uint8)


def in_order(docs: pa.Table) -> pa.Table:
    return docs.sort_by([("doc_id", "ascending")])


def set_tasks(width: int, percent: int, buckets: int):
    def first(docs: pa.Table) -> pa.Table:
        _, keys = shingle_sets(in_order(docs)["text"], width)
        own, counts = tallied(keys & ~LOW)
        return X.requests(docs["chunk"][0].as_py(), own, buckets, counts)

    def last(docs: pa.Table, replies: pa.Table) -> pa.Table:
        docs = in_order(docs)
        rows = docs.num_rows
        row, keys = shingle_sets(docs["text"], width)
        size = np.bincount(row, minlength=rows)
        spread = np.zeros(len(keys), np.uint8)
        if len(keys):
            other = X.bits(replies, "other")
            counts = np.zeros(len(other), np.uint8)
            counts[other] = X.totals(replies, other)
            code = keys & ~LOW
            spread = counts[np.searchsorted(tallied(code)[0], code)]
        shared = spread >= 2
        n_shared = np.bincount(row[shared], minlength=rows)
        zero = np.zeros(1, U64)
        cut = np.concatenate(([0], np.cumsum(size)))
        h1 = np.concatenate((zero, np.cumsum(mix(keys ^ U64(0x8EBC6AF09C88C6E3)))))
        h2 = np.concatenate((zero, np.cumsum(mix(keys + U64(0x589965CC75374CC3)))))
        tokens, prefix = [None] * rows, [0] * rows
        for i in np.flatnonzero((size > 0) & (100 * n_shared >= percent * size)):
            lo, hi = cut[i], cut[i + 1]
            own, df = keys[lo:hi][shared[lo:hi]], spread[lo:hi][shared[lo:hi]]
            n = int(size[i])
            tokens[i] = own[np.lexsort((own, df))].tobytes()
            prefix[i] = max(0, n - (percent * n + 99) // 100 + 1 - (n - len(own)))
        arrays = [docs["doc_id"].combine_chunks() if rows else pa.array([], pa.int64()), pa.array(size.astype(np.int64)), pa.array((h1[cut[1:]] - h1[cut[:-1]]).view(np.int64)), pa.array((h2[cut[1:]] - h2[cut[:-1]]).view(np.int64)), pa.array(tokens, pa.binary()), pa.array(prefix, pa.int32())]
        return pa.Table.from_arrays(arrays, schema=SETS_ARROW)

    return first, last


class Links:
    """Union-find over the sets of one task, with the distances found so far."""

    def __init__(self, labels: list[int]):
        self.up = list(range(len(labels)))
        self.near: list[dict[int, float]] = [{} for _ in labels]
        self.edges: list[tuple[int, int]] = []
        seen: dict[int, int] = {}
        for i, label in enumerate(labels):
            j = seen.setdefault(label, i)
            self.up[i] = j

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((i, j))


def distance(a: np.ndarray, b: np.ndarray, n: int, m: int) -> float:
    """Jaccard distance; a and b are the sorted shared tokens of sets of n and m."""
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    both = int(np.count_nonzero(a[at] == b)) if len(a) else 0
    return 1 - both / (n + m - both)


def block_links(sets: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Edges that connect what the links between these sets connect, and `label` doesn't yet."""
    order = np.lexsort((sets["rep"].to_numpy(), sets["n_shingles"].to_numpy()))
    reps, sizes = sets["rep"].to_numpy()[order], sets["n_shingles"].to_numpy()[order]
    tokens = [np.frombuffer(sets["tokens"][int(i)].as_py(), U64) for i in order]
    prefixes, labels = sets["prefix"].to_numpy()[order], sets["label"].to_numpy()[order].tolist()
    plain = [np.sort(t) for t in tokens]
    found = Links(labels)
    index: dict[int, dict[int, list[int]]] = {}
    slack = 1 - percent / 100 + 1e-12
    for x in range(len(reps)):
        n, extra = int(sizes[x]), int(sizes[x]) - len(tokens[x])
        candidates: dict[int, None] = {}
        for i in range(int(prefixes[x])):
            lists = index.setdefault(int(tokens[x][i]), {})
            if n - extra - i < -(-percent * (n + -(-percent * n // 100)) // (100 + percent)):
                break  # with this as the first shared token, too little of x is left for any size
            for at in sorted(lists):
                if n - at < -(-2 * percent * n // (100 + percent)):
                    break  # this list block and all behind it: too little of their sets is left
                for y in lists[at]:  # by falling size
                    m = int(sizes[y])
                    if 100 * m < percent * n or m - at < -(-percent * (n + m) // (100 + percent)):
                        break
                    candidates[y] = None
            # own position, counted from the front of the whole set
            lists.setdefault(extra + i, []).insert(0, x)
        pivot, to_pivot = -1, 1.0
        for y in candidates:
            if found.root(x) == found.root(y):
                continue
            if pivot >= 0 and y in found.near[pivot]:
                known = found.near[pivot][y]
                if known - to_pivot > slack:
                    continue  # too far from a set that is this near
                if known + to_pivot <= slack:
                    found.join(x, y)
                    continue
            d = distance(plain[x], plain[y], n, int(sizes[y]))
            found.near[x][y] = found.near[y][x] = d
            if d <= slack:
                found.join(x, y)
            if d < to_pivot:
                pivot, to_pivot = y, d
    return [(int(reps[i]), int(reps[j])) for i, j in found.edges]


def link_task(percent: int):
    def run(sets: pa.Table) -> pa.Table:
        edges = block_links(sets, percent)
        return pa.Table.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], schema=EDGES_ARROW)

    return run


def relabel(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """sets (rep, label, ...) with the labels merged along the edges between reps."""
    labels = sets.select("rep", "label")
    e = edges.join(labels.select(F.col("rep").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("rep").alias("b"), F.col("label").alias("lb")), "b")
    to = components(e.select(F.col("la").alias("a"), F.col("lb").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("to"))
    return materialize(sets.join(to, "label", "left").withColumn("label", F.coalesce("to", "label")).select(sets.columns), "jaccard-sets")


MOST_SENT = 500_000


def sent(rows: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """A written table of few short rows for a broadcast join, so that a hot group's sets stay spread; more rows join by shuffle."""
    return F.broadcast(rows) if rows.count() <= most else rows


def joined_groups(sets: DataFrame, percent: int, block: int, delegates: int = 4) -> DataFrame:
    """sets (rep, grp, label, n_shingles, tokens, prefix): labels after all links within each grp."""
    task = link_task(percent)
    sizes = materialize(sets.groupBy("grp").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "jaccard-groups")
    sized = sets.join(sent(sizes), "grp")
    cell = F.pmod(F.xxhash64("rep"), F.ceil(F.col("members") / block))
    edges = materialize(sized.withColumn("cell", cell).groupBy("grp", "cell").applyInArrow(task, EDGES), "jaccard-edges")
    sets = relabel(sets, edges)
    large = materialize(sizes.where(F.col("members") > block), "jaccard-large")
    if not large.limit(1).count():
        return sets
    large = sent(large)
    several = lambda rows: rows.groupBy("grp").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("grp")
    members = None
    while True:  # delegates of the components of each block meet
        now = sets.join(large, "grp")
        now = now.join(sent(materialize(several(now), "jaccard-open")), "grp", "left_semi")
        own = Window.partitionBy("grp", "cell", "label").orderBy("rep")
        parts = F.ceil(F.col("members") / block)
        picked = now.withColumn("cell", F.pmod(F.xxhash64("rep"), parts)).withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= delegates)
        picked = materialize(picked.drop("cell", "nth", "members"), "jaccard-delegates")
        count = picked.count()
        if not count or (members is not None and count >= members):
            break
        members = count
        counts = picked.groupBy("grp").agg(F.count(F.lit(1)).alias("members"))
        cell = F.pmod(F.xxhash64("label", "rep"), F.ceil(F.col("members") / block))
        met = picked.join(counts, "grp").withColumn("cell", cell)
        sets = relabel(sets, materialize(met.groupBy("grp", "cell").applyInArrow(task, EDGES), "jaccard-edges"))
    now = sets.join(large, "grp")
    now = now.join(sent(materialize(several(now), "jaccard-open")), "grp", "left_semi").drop("members")
    if not now.limit(1).count():
        return sets
    # what is still apart: parts of one or few labels meet pairwise, unless both are of one same label
    half = block // 2
    shares = now.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("c"))
    rests = shares.where(F.col("c") < half).groupBy("grp").agg(F.sum("c").alias("r"))
    alone = F.concat_ws(":", "label", F.pmod(F.xxhash64("rep"), F.ceil(F.col("c") / half)))
    mixed = F.concat_ws(":", F.lit("m"), F.pmod(F.xxhash64("label"), F.ceil(F.col("r") / half)))
    now = now.join(shares, ["grp", "label"]).join(rests, "grp", "left").withColumn("part", F.when(F.col("c") >= half, alone).otherwise(mixed)).drop("c", "r")
    now = materialize(now, "jaccard-parts")
    parts = now.groupBy("grp", "part").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    left, right = (parts.select("grp", *(F.col(c).alias(f"{c}_{s}") for c in ("part", "lo", "hi"))) for s in "ab")
    pairs = left.join(right, "grp").where("part_a <= part_b and not (lo_a = hi_a and lo_b = hi_b and lo_a = lo_b)").select("grp", "part_a", "part_b")
    pairs = materialize(pairs, "jaccard-pairs")
    sides = pairs.select("*", F.col("part_a").alias("part")).union(pairs.where("part_a < part_b").select("*", F.col("part_b").alias("part")))
    met = now.join(sides, ["grp", "part"])
    return relabel(sets, materialize(met.groupBy("grp", "part_a", "part_b").applyInArrow(task, EDGES), "jaccard-edges"))


def jaccard_join(docs: DataFrame, width: int = 5, percent: int = 75, chunk_bytes: int = 8 << 20, bucket_bytes: int = 48 << 20, block: int = 128) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id that links reach) of every row. docs needs doc_id and text."""
    bounds, n_bytes = chunk_bounds(measured(docs), chunk_bytes)
    chunked, chunks = with_chunks(docs, bounds), len(bounds) + 1
    buckets = max(12, -(-n_bytes // bucket_bytes))
    first, last = set_tasks(width, percent, buckets)
    every = materialize(X.rounds(chunked, chunks, buckets, [first], [SHIFT], last, SETS), "jaccard-every")
    alive = every.where("tokens is not null")
    reps = materialize(alive.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles"), F.first("tokens").alias("tokens"), F.first("prefix").alias("prefix")), "jaccard-reps")
    held = materialize(token_rows(reps), "jaccard-tokens")
    least = materialize(held.groupBy("token").agg(F.min("rep").alias("root"), F.count(F.lit(1)).alias("n")).where("n > 1").select("token", "root"), "jaccard-roots")
    coarse = components(held.join(least, "token").select(F.col("rep").alias("a"), F.col("root").alias("b")).distinct())
    sets = coarse.select(F.col("node").alias("rep"), F.col("label").alias("grp")).join(reps, "rep").select("rep", "grp", F.col("rep").alias("label"), "n_shingles", "tokens", "prefix")
    labels = joined_groups(materialize(sets, "jaccard-sets"), percent, block).select("rep", "label")
    of_set = materialize(reps.select("h1", "h2", "rep").join(labels, "rep", "left").select("h1", "h2", F.coalesce("label", "rep").alias("component_id")), "jaccard-labels")
    out = alive.join(of_set, ["h1", "h2"]).select("doc_id", "n_shingles", "component_id")
    out = out.union(every.where("tokens is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.select(*(F.when(F.col(c) != -(2**63), F.col(c)).alias(c) if c != "n_shingles" else F.col(c) for c in out.columns))


def token_rows(reps: DataFrame) -> DataFrame:
    """(token, rep) for the prefix tokens of each set."""

    def run(batches):
        for batch in batches:
            reps_, tokens, prefix = batch["rep"].to_numpy(zero_copy_only=False), batch["tokens"], batch["prefix"].to_pylist()
            parts = [np.frombuffer(tokens[i].as_py(), U64)[:k] for i, k in enumerate(prefix)]
            flat = np.concatenate(parts) if parts else np.zeros(0, U64)
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(np.repeat(reps_, [len(p) for p in parts]))], names=["token", "rep"])

    return reps.select("rep", "tokens", "prefix").mapInArrow(run, "token long, rep long")


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
