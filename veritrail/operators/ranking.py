"""Latest-per-key, replay, queues, keyset pages, seeded order and samples."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEPARATOR = "\x1f"


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by `order`: a max_by over whole rows, so only one row a key and task is shuffled."""
    row = F.struct(*df.columns)
    top = df.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("_row"))
    return top.select("_row.*")


def first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by `order`: of repeated commands, the one that counts."""
    row = F.struct(*df.columns)
    return df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("_row")).select("_row.*")


def replay(events: DataFrame, keys: list[str], seq: str, kind: str, undo: str, cutoff: int | None = None) -> DataFrame:
    """State after undos: the last event of each key that no later undo of the key takes back, up to a sequence."""
    if cutoff is not None:
        events = events.where(F.col(seq) <= cutoff)
    own = events.groupBy(*keys).agg(
        F.max(F.when(F.col(kind) == undo, F.col(seq))).alias("_undo"),
        F.max_by(F.struct(kind, seq), F.when(F.col(kind) != undo, F.col(seq))).alias("_last"),
    )
    live = F.col("_undo").isNull() | (F.col(f"_last.{seq}") > F.col("_undo"))
    return own.where(F.col("_last").isNotNull() & live).select(*keys, F.col(f"_last.{kind}").alias(kind), F.col(f"_last.{seq}").alias(seq))


def replay_stack(events: DataFrame, keys: list[str], seq: str, kind: str, undo: str, cutoff: int | None = None) -> DataFrame:
    """State when each undo takes back one event, the last that still stands; one ordered pass over each key's events."""
    if cutoff is not None:
        events = events.where(F.col(seq) <= cutoff)
    own, kinds = events.select(*keys, kind, seq), dict(events.dtypes)

    def fold(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(seq)
        stack: list[int] = []
        for i, k in enumerate(rows[kind].to_pylist()):
            if k != undo:
                stack.append(i)
            elif stack:
                stack.pop()
        return rows.slice(stack[-1], 1) if stack else rows.slice(0, 0)

    return own.groupBy(*keys).applyInArrow(fold, ", ".join(f"{c} {kinds[c]}" for c in own.columns))


def seeded_key(seed: str, *parts: Column) -> Column:
    """A place in a random but repeatable order: the SHA-256 of seed and parts."""
    return F.sha2(F.concat_ws(SEPARATOR, F.lit(seed), *[p.cast("string") for p in parts]), 256)


def queue_position(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Rows with their position in each queue, from 1."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def seeded_sample(df: DataFrame, by: list[str], ref: str, k: int, seed: str) -> DataFrame:
    """k rows per stratum without replacement: those with the least seeded hashes.

    Tasks first keep their own k smallest, so a hot stratum sends k rows a task, not all.
    """
    keyed = df.withColumn("_key", seeded_key(seed, *[F.col(b) for b in by], F.col(ref)))
    own = Window.partitionBy(*by).orderBy("_key", ref)
    return keyed.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= k).drop("_n").withColumnRenamed("_key", "sort_key")


def split_pool(df: DataFrame, by: list[str], ref: str, pool: list[str], seed: str) -> DataFrame:
    """Rows dealt to the pool in turn along the seeded order of each group.

    A row's place is its rank within a slice of the hash range, after the rows of the slices before (at most 4,096 a group), so a group is no task.
    """
    own = df.withColumn("_h", seeded_key(seed, F.col(ref))).withColumn("_slice", F.substring("_h", 1, 3))
    before = F.sum("_c").over(Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    skips = own.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_c")).withColumn("_skip", F.coalesce(before, F.lit(0)))
    skips = skips.select("_skip", *(F.col(c).alias(f"_of_{c}") for c in (*by, "_slice")))
    own = own.withColumn("_i", F.row_number().over(Window.partitionBy(*by, "_slice").orderBy("_h", ref)) - 1)
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*by, "_slice")))
    place = ((F.col("_i") + F.col("_skip")) % len(pool)).cast("int")
    return own.join(skips, same).select(*df.columns, F.get(F.array(*map(F.lit, pool)), place).alias("reader"))


def second_reader(df: DataFrame, ref: str, first: str, pool: list[str], seed: str) -> DataFrame:
    """Another member of the pool: the one with the least hash."""
    ranked = F.array_sort(F.array(*[F.struct(seeded_key(seed, F.lit(p), F.col(ref)).alias("h"), F.lit(p).alias("p")) for p in pool]))
    return df.withColumn("second", F.get(F.filter(ranked, lambda s: s["p"] != F.col(first)), F.lit(0))["p"])


def page_after(df: DataFrame, order: list[str], after: tuple | None, limit: int) -> DataFrame:
    """The page behind a position: limit rows and one more that tells whether there are further ones."""
    if after is not None:
        place = None
        for i, (column, value) in enumerate(zip(order, after)):
            here = F.col(column) > F.lit(value)
            for c, v in zip(order[:i], after[:i]):
                here = (F.col(c) == F.lit(v)) & here
            place = here if place is None else place | here
        df = df.where(place)
    return df.orderBy(*order).limit(limit + 1)


def share_of(percent: Column, n: Column) -> Column:
    """Percent of n, rounded up, exactly."""
    return F.ceil(percent.cast("decimal(20,6)") * n / 100).cast("long")


def running_prefix(df: DataFrame, by: list[str], order: str, decided: Column) -> DataFrame:
    """Rows before the first undecided one of each group."""
    first = df.groupBy(*by).agg(F.min(F.when(~decided, F.col(order))).alias("_first"))
    return df.join(first, by).where(F.col("_first").isNull() | (F.col(order) < F.col("_first"))).drop("_first")


def previous(df: DataFrame, by: list[str], order: str, column: str, name: str) -> DataFrame:
    return df.withColumn(name, F.lag(column).over(Window.partitionBy(*by).orderBy(order)))


def carried(df: DataFrame, by: list[str], order: str, column: str, name: str) -> DataFrame:
    """The nearest non-null value at or before each row."""
    own = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(column, ignorenulls=True).over(own))


def islands(df: DataFrame, by: list[str], start: str, end: str, gap: int, order: str | None = None) -> DataFrame:
    """Rows with the number of the passage they are in: a start `gap` or more past the last end begins a new one. order: their order, if not by start and end."""
    own = Window.partitionBy(*by).orderBy(*([order] if order else [start, end]))
    before = F.max(end).over(own.rowsBetween(Window.unboundedPreceding, -1))
    opened = F.when(before.isNull() | (F.col(start) - before >= gap), 1).otherwise(0)
    return df.withColumn("_open", opened).withColumn("passage", F.sum("_open").over(own.rowsBetween(Window.unboundedPreceding, 0))).drop("_open")
