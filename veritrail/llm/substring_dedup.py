"""Substring dedup: Rabin-Karp hashes of every window of words, counted in buckets that Spark deals.

Every window of `window` consecutive words gets a Rabin-Karp hash. Two exchanges (see exchange.py) sort and count
them over the whole corpus, a bucket of hashes a task: 40 bits find the windows that may repeat, then 64 bits of a second
polynomial decide. A window goes if its words also start earlier (a smaller doc_id, or the
same document further left); overlapping windows merge into maximal removal intervals.

Two different windows are taken as equal only if all 104 bits agree.

Defined cases: a null text has no words and comes back as an empty text; a null doc_id
counts as the smallest; rows that share a doc_id are one document, in the order of their
texts; texts shorter than a window stay; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm import exchange as X
from veritrail.llm.common import INVERSE, U64, chunk_bounds, measured, powers, prefix_hash, run_hash, utf8, with_chunks, word_hashes, words_of

SCHEMA = "doc_id long, text string, n_words long, n_removed long, spans array<struct<start:long,end:long>>"
ARROW = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
SHIFT = 24
LOW = U64((1 << SHIFT) - 1)


def in_order(docs: pa.Table) -> pa.Table:
    return docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])


class Windows:
    """The windows of one chunk: hash, second hash, first word, all in (doc_id, place) order."""

    def __init__(self, docs: pa.Table, window: int):
        self.raw, self.off = utf8(docs["text"])
        self.starts, self.ends, self.first = words_of(self.raw, self.off)
        n = len(self.starts)
        last = np.repeat(self.first[1:], np.diff(self.first))  # of each word, the end of its row
        self.at = np.flatnonzero(np.arange(n) + window <= last)
        self.window = window

    def hashes(self, seed: int) -> np.ndarray:
        if not len(self.at):
            return np.zeros(0, U64)
        sums = prefix_hash(word_hashes(self.raw, self.starts, self.ends, seed))
        return run_hash(sums, self.at, self.at + self.window, powers(INVERSE, len(self.starts)))


def repeated_here(keys: np.ndarray) -> np.ndarray:
    """Which keys stand twice or more in the array."""
    by = np.argsort(keys, kind="stable")
    s = keys[by]
    same = s[1:] == s[:-1]
    out = np.zeros(len(keys), bool)
    out[by[1:][same]] = True
    out[by[:-1][same]] = True
    return out


def later_here(keys: np.ndarray) -> np.ndarray:
    """Which keys stand before in the array."""
    by = np.argsort(keys, kind="stable")
    s = keys[by]
    out = np.zeros(len(keys), bool)
    out[by[1:][s[1:] == s[:-1]]] = True
    return out


def tasks(window: int, buckets: int):
    def first(docs: pa.Table) -> pa.Table:
        chunk = docs["chunk"][0].as_py()
        w = Windows(in_order(docs), window)
        return X.requests(chunk, X.distinct(w.hashes(1) & ~LOW), buckets)

    def candidates(w: Windows, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows that may repeat; which of them may repeat elsewhere; their second hashes."""
        keys = w.hashes(1) & ~LOW
        elsewhere = flags[np.searchsorted(X.distinct(keys), keys)]
        may = elsewhere | repeated_here(keys)
        return np.flatnonzero(may), elsewhere[may], w.hashes(2)[may]

    def second(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return X.REQUEST_ARROW.empty_table()
        chunk = docs["chunk"][0].as_py()
        flags = X.bits(replies, "other")
        if not len(flags):
            return X.REQUEST_ARROW.empty_table()
        _, elsewhere, keys = candidates(Windows(in_order(docs), window), flags)
        return pa.concat_tables([X.forward(chunk, 0, flags), X.requests(chunk, X.distinct(keys[elsewhere]), buckets)])

    def last(docs: pa.Table, replies: pa.Table) -> pa.Table:
        docs = in_order(docs)
        w = Windows(docs, window)
        n = len(w.starts)
        gone = np.zeros(n, bool)
        kept = X.kept_bits(replies)
        if kept and len(kept[0]):
            may, elsewhere, keys = candidates(w, kept[0])
            earlier = X.bits(X.asked_now(replies), "earlier")
            drop = later_here(keys)
            if len(earlier):
                drop[elsewhere] |= earlier[np.searchsorted(X.distinct(keys[elsewhere]), keys[elsewhere])]
            at = w.at[may[drop]]
            change = np.zeros(n + 1, np.int64)
            np.add.at(change, at, 1)
            np.add.at(change, at + window, -1)
            gone = np.cumsum(change[:-1]) > 0
        words = np.diff(w.first)
        removed = np.concatenate(([0], np.cumsum(gone)))[w.first]
        data = w.raw.tobytes()
        texts, spans = [], []
        for i in range(docs.num_rows):
            own = data[w.off[i] : w.off[i + 1]].split()
            lo, hi = int(w.first[i]), int(w.first[i + 1])
            if removed[i + 1] > removed[i]:
                g = gone[lo:hi]
                edge = np.flatnonzero(np.diff(np.concatenate(([0], g.view(np.int8), [0]))))
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])])
                own = compress(own, ~g)
            else:
                spans.append([])
            texts.append(b" ".join(own))
        arrays = [docs["doc_id"].combine_chunks() if docs.num_rows else pa.array([], pa.int64()), pc.cast(pa.array(texts, pa.binary()), pa.string()), pa.array(words, pa.int64()), pa.array(np.diff(removed), pa.int64()), pa.array(spans, ARROW.field("spans").type)]
        return pa.Table.from_arrays(arrays, schema=ARROW)

    return first, second, last


def substring_dedup(docs: DataFrame, window: int = 20, chunk_bytes: int = 8 << 20, bucket_bytes: int = 48 << 20) -> DataFrame:
    """doc_id, text (kept words joined by one space), n_words, n_removed, spans (of removed words) of every row.

    docs needs doc_id and text. A chunk's words and a bucket's keys are what one task holds;
    both numbers grow with the input.
    """
    bounds, n_bytes = chunk_bounds(measured(docs), chunk_bytes)
    chunked, chunks = with_chunks(docs, bounds), len(bounds) + 1
    buckets = max(12, -(-n_bytes // bucket_bytes))
    first, second, last = tasks(window, buckets)
    out = X.rounds(chunked, chunks, buckets, [first, second], [SHIFT, 0], last, SCHEMA)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != -(2**63), F.col("doc_id")))


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    from veritrail.llm.common import table

    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
