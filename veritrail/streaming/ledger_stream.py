"""Ledger ingest as a stream: a fold per project that checks the sequence and the hash links.

An extension: the reference keeps its ledger in a database. Events may come late and out of
order; those ahead of the sequence wait in state, repeated ones are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from veritrail.operators.ledger import GENESIS

EVENT = "project_id long, seq long, event_id string, type string, payload string, prev_hash string, event_hash string"
OUT = "project_id long, seq long, status string"
STATE = "next long, head string, waiting array<struct<seq:long,prev_hash:string,event_hash:string>>"


def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Accept events in sequence; say which broke the link, which came again."""
    upcoming, head, waiting = state.get if state.exists else (1, GENESIS, [])
    held = {int(w[0]): (w[1], w[2]) for w in waiting}
    out = []
    for batch in batches:
        for e in batch.itertuples():
            if e.seq < upcoming or int(e.seq) in held:
                out.append((key[0], int(e.seq), "repeated"))
            else:
                held[int(e.seq)] = (e.prev_hash, e.event_hash)
    while upcoming in held:
        prev, own = held.pop(upcoming)
        out.append((key[0], upcoming, "accepted" if prev == head else "broken_link"))
        head, upcoming = own, upcoming + 1
    state.update((upcoming, head, [(s, p, h) for s, (p, h) in sorted(held.items())]))
    yield pd.DataFrame(out, columns=["project_id", "seq", "status"])


def ingest(spark: SparkSession, path: str) -> DataFrame:
    """The stream of (project_id, seq, status) for event files that appear at path (JSON lines)."""
    events = spark.readStream.schema(EVENT).json(path)
    return events.groupBy("project_id").applyInPandasWithState(fold, OUT, STATE, "append", "NoTimeout")


def answer_texts(chunks: DataFrame) -> DataFrame:
    """Answers from their streamed pieces (request, n, piece)."""
    from pyspark.sql import functions as F

    return chunks.groupBy("request").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "piece"))), lambda s: s["piece"]), "").alias("text"))


def commands_once(commands: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each receipt id once, in a stream or a batch."""
    if commands.isStreaming:
        return commands.withWatermark("sent_at", late).dropDuplicatesWithinWatermark(["receipt_id"])
    return commands.dropDuplicates(["receipt_id"])
