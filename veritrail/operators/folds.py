"""Ordered folds over groups: Spark deals and sorts the rows, Python goes through them once, a group at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a result that are sent at once.
SENT = 8192


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Rows dealt to all shuffle partitions by the columns (none: evenly); few bytes stand for much work, so they aren't coalesced."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def dealt_by_size(rows: DataFrame, text: str, by: str, made: Callable[[DataFrame], DataFrame] = lambda rows: rows, bytes: int = 4 << 20) -> DataFrame:
    """What is made of rows, dealt by a column so that a task gets about so many bytes of the rows' text, however large the input."""
    total = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return made(rows).repartition(max(least, -(-total // bytes)), by)


def folded(rows: DataFrame, keys: list[str], order: list[str | Column], fold: Callable[[list[tuple]], Iterable[tuple]], schema: str | T.StructType) -> DataFrame:
    """What `fold` makes of the rows of each group, as rows of `schema`.

    Rows come as tuples of all columns, sorted by `order`; a group may go over batches. Many small groups cost
    a few steps each, not a frame each.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    own = rows.select(*keys, *[c for c in rows.columns if c not in keys])
    kind = to_arrow_schema(schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema))
    at, n = [own.columns.index(c) for c in rows.columns], len(keys)

    def made(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out) if out else ((),) * len(kind)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kind.types)], schema=kind)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        key, held = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[:n] != key:
                    yield held
                    held = []
                key = row[:n]
                held.append(tuple(row[i] for i in at))
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group in groups(batches):
            for row in fold(group):
                out.append(row)
                if len(out) >= SENT:
                    yield made(out)
                    out = []
        yield made(out)

    return dealt(own, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
