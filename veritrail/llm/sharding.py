"""Sharding: best-fit-decreasing bin packing of indivisible groups.

Rows with equal texts are one group. Groups, by falling size, enter the bin with the tightest
remaining capacity that still holds them, found in a balanced tree; the capacity is the least
one for which the bins suffice. The law is `bytes`: sizes near equal.

Every group is packed by its size, rounded up to BITS significant bits (by 0.05 % at most). Groups of
one rounded size are a class, and a class is dealt at once, so the driver packs classes: under
2 ** BITS for each doubling of the size, whatever the rows. Which groups of a class go where
follows from their numbers in it. A group beyond a shard's fair share gets a shard for itself.

Defined cases: a null text has no bytes and size 1, crc 0, and its rows are one group; repeated
rows are rows of their own; an empty table gives an empty result; null doc_ids come first.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrail.llm.common import materialize, table


#: Rows that one window holds, about.
CELL_ROWS = 200_000


class _Node:
    __slots__ = ("key", "heap", "left", "right")

    def __init__(self, key, heap):
        self.key, self.heap, self.left, self.right = key, heap, None, None


class BinTree:
    """A treap of (remaining capacity, bin)."""

    def __init__(self):
        self.root, self._dice = None, random.Random(7)

    def _split(self, node, key):
        if node is None:
            return None, None
        if node.key < key:
            node.right, high = self._split(node.right, key)
            return node, high
        low, node.left = self._split(node.left, key)
        return low, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a.heap < b.heap:
            a.right = self._merge(a.right, b)
            return a
        b.left = self._merge(a, b.left)
        return b

    def add(self, key) -> None:
        low, high = self._split(self.root, key)
        self.root = self._merge(self._merge(low, _Node(key, self._dice.random())), high)

    def take_tightest(self, size: int):
        """Remove and return the least (remaining, bin) with remaining >= size, or None."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        above, node = None, high
        while node.left is not None:
            above, node = node, node.left
        if above is None:
            high = node.right
        else:
            above.left = node.right
        self.root = self._merge(low, high)
        return node.key


def pack(classes: list[tuple[int, int]], capacity: int, bins: int) -> list[tuple[int, int, int]] | None:
    """(class, bin, groups) runs for classes of (size, groups) by falling size, or None if `bins` bins of the capacity don't suffice.

    Equal sizes one after another: the tightest bin that holds the first stays the tightest until it holds
    no more of them, so a class is dealt bin by bin, with the same result as group by group.
    """
    tree, used, out = BinTree(), 0, []
    for c, (size, groups) in enumerate(classes):
        while groups:
            found = tree.take_tightest(size)
            if found is None:
                if used == bins or size > capacity:
                    return None
                found, used = (capacity, used), used + 1
            n = min(groups, found[0] // size)
            tree.add((found[0] - n * size, found[1]))
            out.append((c, found[1], n))
            groups -= n
    return out


def best_fit_decreasing(classes: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int]]:
    """Runs (class, bin, groups) of classes of (size, groups) by falling size, with the least capacity that fits."""
    out, rest, first = [], [list(c) for c in classes], 0
    total, at = sum(size * n for size, n in classes), 0
    while first < bins - 1 and at < len(rest) and rest[at][0] * (bins - first) > total:  # more than a fair share
        out.append((at, first, 1))
        total -= rest[at][0]
        rest[at][1] -= 1
        first += 1
        at += not rest[at][1]
    left, sizes = bins - first, [tuple(c) for c in rest]
    low, high = max([-(-total // left), 1, *(size for size, n in sizes[at : at + 1])]), max(total, 1)
    best = pack(sizes, low, left)
    if best is None:
        step = max(1, total // left // 4096)
        while best is None:  # widen quickly, then narrow
            best, high = pack(sizes, low + step, left), low + step
            low, step = (low + step, step * 2) if best is None else (low, step)
        while high - low > max(1, total // left // 100_000):
            mid = (low + high) // 2
            found = pack(sizes, mid, left)
            low, high, best = (mid, high, best) if found is None else (low, mid, found)
    return out + [(c, b + first, n) for c, b, n in best]


#: Bits of a group's size that packing sees.
BITS = 12


def rounded(size: Column) -> Column:
    """The size rounded up to BITS significant bits."""
    shift = F.greatest(F.lit(0), F.length(F.bin(size)) - BITS)
    unit = F.pow(F.lit(2.0), shift).cast("long")
    return ((size + unit - 1) / unit).cast("long") * unit


def numbered(df: DataFrame, by: list[str], order: list[str], cells: Column) -> DataFrame:
    """df with nth, gapless from 0 in each group of `by`: a window in each of `cells` parts of a group, behind the parts before it.

    Part sizes go to the driver: one row for each part there is.
    """
    own = df.withColumn("_cell", F.pmod(F.xxhash64(*order), cells))
    counts = own.groupBy(*by, "_cell").agg(F.count(F.lit(1)).alias("n")).collect()
    before: dict[tuple, int] = {}
    starts = []
    for c in sorted(counts, key=lambda c: c["_cell"]):
        key = tuple(c[b] for b in by)
        starts.append((*key, c["_cell"], before.get(key, 0)))
        before[key] = before.get(key, 0) + c["n"]
    kinds = dict(own.dtypes)
    starts = df.sparkSession.createDataFrame(starts, ", ".join(f"{c} {kinds[c]}" for c in [*by, "_cell"]) + ", _start long")
    nth = F.row_number().over(Window.partitionBy(*by, "_cell").orderBy(*order))
    return own.withColumn("_nth", nth).join(F.broadcast(starts), [*by, "_cell"]).withColumn("nth", F.col("_start") + F.col("_nth") - 1).drop("_cell", "_nth", "_start")


def shard_by_bytes(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row. docs needs doc_id and text."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    base = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.when(text.isNull(), F.lit(0)).otherwise(F.xxhash64(text)).alias("grp"),
        ),
        "shard-base",
    )
    groups = materialize(base.groupBy("grp").agg(F.sum("size").alias("bytes")).select("grp", rounded(F.col("bytes")).alias("class")), "shard-groups")
    sizes = sorted(((r["class"], r["n"]) for r in groups.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)  # under 2 ** BITS rows for each doubling of the size
    runs, dealt = [], [0] * len(sizes)
    for c, bin_, n in best_fit_decreasing(sizes, shards):
        runs.append((sizes[c][0], dealt[c], dealt[c] + n, bin_))
        dealt[c] += n
    runs = spark.createDataFrame(runs, "class long, lo long, hi long, shard int")
    large = spark.createDataFrame([(size, -(-n // CELL_ROWS)) for size, n in sizes if n > CELL_ROWS], "class long, _parts long")  # all other classes are one part
    parted = groups.join(F.broadcast(large), "class", "left")
    placed = numbered(parted, ["class"], ["grp"], F.coalesce("_parts", F.lit(1))).drop("_parts").join(F.broadcast(runs), "class").where((F.col("nth") >= F.col("lo")) & (F.col("nth") < F.col("hi"))).select("grp", "shard")
    rows = base.join(materialize(placed, "shard-placed"), "grp")
    cells = max(64, -(-base.count() // shards // CELL_ROWS))
    return numbered(rows, ["shard"], ["doc_id", "text_crc32", "size"], F.lit(cells)).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("nth").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))
