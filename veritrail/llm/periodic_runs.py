"""Periodic run detection: stretches of words that repeat with a period, and texts without the repeats.

A run is a maximal stretch whose words a period apart are identical, of at least `least` words and
`repeats` periods. For each period p, grid points stand about p words apart, so that each run
has one in its first words; all pairs (p, grid point) whose words agree are extended to both sides at once, by
binary search over prefix hashes. A stretch that several grid points or multiples of its period find
is kept once, with its least period, and its words are compared as bytes.

Documents of one slice share one grid: they stand end to end, longest first, so period p looks at the
front of the slice alone, where texts of `repeats` * p words are. A document's runs depend on it alone, so
nothing is shuffled; a task holds one slice (SLICE bytes of text, or one document).

Defined cases: a null or text without words has no runs, and an empty text remains of it; repeated rows are
rows of their own; null doc_ids stay null; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import BASE, U64, WORD_GAP, powers, prefix_hash, slices, table, utf8, word_hashes, words_of

SCHEMA = "doc_id long, text string, n_words long, runs array<struct<start: long, length: long, period: long>>"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
ARROW = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("runs", pa.list_(RUN))])
#: Bytes of text that are looked at together.
SLICE = 4 << 20


def grid_pairs(words: np.ndarray, sizes: np.ndarray, least: int, repeats: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(period, grid point, words that must agree from there) wherever the words a period apart agree.

    words: texts end to end, longest first, each with a mark of its own behind it. In a run of period p the first
    m = max(least, repeats * p) - p words at least equal those p later. Of points half of m apart one is
    among the first half of these, so half of m words agree from there.
    """
    ends = np.cumsum(sizes + 1)
    period, at, block = [], [], []
    for p in range(1, int(sizes.max(initial=0)) // repeats + 1):
        texts = int(np.searchsorted(-sizes, -max(least, repeats * p), side="right"))
        if not texts:
            break
        upto = int(ends[texts - 1]) - p
        m = max(least, repeats * p) - p
        step = (m + 1) // 2
        hits = np.flatnonzero(words[:upto:step] == words[p : p + upto : step])
        if len(hits):
            period.append(np.full(len(hits), p))
            at.append(hits * step)
            block.append(np.full(len(hits), m - step + 1))
    none = [np.zeros(0, np.int64)]
    return np.concatenate(period or none), np.concatenate(at or none), np.concatenate(block or none)


def extension(sums: np.ndarray, at: np.ndarray, period: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """How many words from `at` on (back: before it) equal those a period later, for all pairs at once; `most` is known to suffice."""
    shift = powers(BASE, int(period.max(initial=0)) + 1)[period]

    def same(k: np.ndarray) -> np.ndarray:
        lo, hi = (at - k, at) if back else (at, at + k)
        return (sums[hi] - sums[lo]) * shift == sums[hi + period] - sums[lo + period]

    low, high = np.zeros(len(at), np.int64), most.astype(np.int64)
    while (low < high).any():
        mid = (low + high + 1) // 2
        ok = same(mid)
        low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
    return low


def found_runs(hashes: np.ndarray, first: np.ndarray, least: int, repeats: int) -> np.ndarray:
    """(text, start, length, period) rows of all runs, by text and start. first: the first word of each text, and the end."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] >= max(least, repeats)]
    sizes = size[order]
    begin = np.concatenate(([0], np.cumsum(sizes + 1)))
    words = np.empty(int(begin[-1]), U64)
    for place, text in enumerate(order.tolist()):
        words[begin[place] : begin[place + 1] - 1] = hashes[first[text] : first[text + 1]]
    words[begin[1:] - 1] = prefix_hash(np.arange(len(order), dtype=U64) + U64(7))[1:]  # marks, no two alike
    period, at, block = grid_pairs(words, sizes, least, repeats)
    sums = prefix_hash(words)
    text = np.searchsorted(begin, at, side="right") - 1
    end = begin[text + 1] - 1
    fits = at + block + period <= end
    period, at, block, text, end = (x[fits] for x in (period, at, block, text, end))
    shift = powers(BASE, int(period.max(initial=0)) + 1)[period]
    alike = (sums[at + block] - sums[at]) * shift == sums[at + block + period] - sums[at + period]
    period, at, text, end = (x[alike] for x in (period, at, text, end))
    start = at - extension(sums, at, period, at - begin[text], True)
    stop = at + period + extension(sums, at, period, end - at - period, False)
    full = stop - start >= np.maximum(least, repeats * period)
    period, start, stop, text = (x[full] for x in (period, start, stop, text))
    by = np.lexsort((period, stop, start))
    period, start, stop, text = (x[by] for x in (period, start, stop, text))
    new = np.concatenate(([True], (start[1:] != start[:-1]) | (stop[1:] != stop[:-1]))) if len(by) else np.zeros(0, bool)
    rows = np.stack((order[text], start - begin[text], stop - start, period), axis=1)[new]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def exact_runs(words: list[bytes], least: int, repeats: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of one text without hashes, in the square of its words; for texts where two hashes clash."""
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    best: dict[tuple[int, int], int] = {}
    for p in range(1, len(ids) // repeats + 1):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids[p:] == ids[:-p]).view(np.int8), [0]))))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b + p - a >= max(least, repeats * p):
                best.setdefault((a, b + p), p)
    return sorted((a, b - a, p) for (a, b), p in best.items())


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    kept = np.cumsum(change[:-1]) == 0
    return [w for w, k in zip(words, kept.tolist()) if k]


def slice_runs(raw: np.ndarray, off: np.ndarray, least: int, repeats: int) -> tuple[list[bytes], list[int], list[list[tuple[int, int, int]]]]:
    """(remaining text, words, runs) of each text of a slice."""
    starts, ends, first = words_of(raw, off)
    rows = found_runs(word_hashes(raw, starts, ends, 31), first, least, repeats)
    runs: list[list] = [[] for _ in range(len(off) - 1)]
    for text, *run in rows.tolist():
        runs[text].append(tuple(run))
    data, texts = raw.tobytes(), []
    for i in range(len(runs)):
        words = data[off[i] : off[i + 1]].split()
        if runs[i]:
            if any(words[s : s + n - p] != words[s + p : s + n] for s, n, p in runs[i]):
                runs[i] = exact_runs(words, least, repeats)
            words = collapsed(words, runs[i])
        texts.append(b" ".join(words))
    return texts, np.diff(first).tolist(), runs


def finder(least: int, repeats: int):
    def run(batches):
        for batch in batches:
            raw, off = utf8(batch["text"])
            for lo, hi in slices(off, SLICE):
                texts, counts, runs = slice_runs(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], least, repeats)
                flat = [r for own in runs for r in own]
                columns = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
                cut = pa.array(np.concatenate(([0], np.cumsum([len(own) for own in runs]))), pa.int32())
                lists = pa.ListArray.from_arrays(cut, pa.StructArray.from_arrays(columns, fields=list(RUN)))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, hi - lo), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), lists], schema=ARROW)

    return run


def periodic_runs(docs: DataFrame, least: int = 24, repeats: int = 3) -> DataFrame:
    """doc_id, text (words that no run repeats, joined by one space), n_words, runs (start, length, period; by start, then period).

    docs needs doc_id and text.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(finder(least, repeats), SCHEMA)


def with_planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; in a tenth of the documents, dealt by the crc32 of doc_id, the words from one place on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    words = F.filter(F.split("text", WORD_GAP), lambda w: w != "")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), h.alias("h"))
    own = own.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words")).withColumn("g", F.floor(F.col("h") / 10))
    own = own.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    own = own.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    planted = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get(F.col("words"), place(i))), " ")
    return own.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; the first of equal ones."""
    better = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(better(r, best), r).otherwise(best))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    out = periodic_runs(with_planted(table(spark, sf_dir, "documents"))).withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    )
