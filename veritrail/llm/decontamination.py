"""Benchmark decontamination by q-gram lemma filtering.

A text region within k edits of an item of n characters shares at least n - q + 1 - k * q of
the item's q-grams. Every text is scanned once: q-grams that no item has are skipped; stretches
with enough known q-grams go on; there the shared q-grams are counted by item in overlapping
bands of diagonals (2 * (k + 1) wide, k + 1 apart: an alignment with k edits spans at most
k + 1 diagonals, so one band holds it whole); bands that reach the bound are verified by
banded alignment. Case and the kind and length of white space don't count as edits.

k is `budget` of an item's characters, rounded down; q is `q` or the largest that leaves a
bound of at least 1. Items are sent to the tasks up to `block_bytes` of text; what is built of
them holds about 28 bytes for a character (120 MB for the default). A larger benchmark is taken
in blocks, each against all texts.

Defined cases: null or blank texts and items match nothing, nor do items of fewer than `least`
characters; null ids are carried along; equal
items are reported one by one; an empty benchmark matches nothing; a region is reported once
for each item, the one with the fewest edits, then the leftmost. Positions are in the text
with each run of white space as one space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import INVERSE, U64, give_back, materialize, mix, powers, prefix_hash, table

HITS = "doc_id long, item_id long, start long, end long, edits int"
HITS_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())])
SEGMENT = 1 << 19
SLOTS = 1 << 22
#: Items under this many characters say nothing: they would match in most texts.
LEAST = 10
#: Rows of (hit, item) that are expanded at once.
EXPANDED = 1 << 20


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(code: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all q-grams."""
    if len(code) < q:
        return np.zeros(0, U64)
    sums = prefix_hash(code.astype(U64) * U64(0x9FB21C651E98DF25) + U64(1))
    n = len(code) - q + 1
    return mix((sums[q:] - sums[:-q]) * powers(INVERSE, n))


class Items:
    """The q-grams of the items, by q."""

    def __init__(self, rows: list[tuple[int | None, str]], budget: float, q: int, least: int = 1):
        self.rows = [(i, t) for i, t in rows if len(t) >= least]
        n = np.array([len(t) for _, t in self.rows], np.int64)
        self.n, self.k = n, np.floor(n * budget + 1e-9).astype(np.int64)
        self.q = np.minimum(q, n // (self.k + 1))  # n - q + 1 - k * q >= 1
        self.bound = n - self.q + 1 - self.k * self.q
        self.code = [codes(t) for _, t in self.rows]
        self.by_q = {}
        for size in sorted(set(self.q.tolist())):
            own = np.flatnonzero(self.q == size)
            parts = [grams(self.code[i], size) for i in own]
            h = np.concatenate(parts)
            item = np.repeat(own, [len(p) for p in parts])
            at = np.concatenate([np.arange(len(p)) for p in parts])
            by = np.argsort(h, kind="stable")
            h, item, at = h[by], item[by], at[by]
            head = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            slots = np.zeros(SLOTS, np.uint8)
            slots[(h & U64(SLOTS - 1)).astype(np.int64)] = 1
            classes = []  # items of similar length share one test of how many known q-grams a stretch has
            low = int(n[own].min())
            while low <= int(n[own].max()):
                some = own[(n[own] >= low) & (n[own] < low * 3 // 2 + 1)]
                if len(some):
                    classes.append((int((n[some] + self.k[some]).max()), int(self.bound[some].min())))
                low = low * 3 // 2 + 1
            self.by_q[size] = (h[head], np.concatenate((head, [len(h)])), item, at, slots, classes)
        self.longest = int((n + self.k).max()) if len(n) else 0


def verify(item: np.ndarray, text: np.ndarray, low: int, k: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best stretch of text within k edits of item on the 2 * (k + 1) diagonals from `low` on.

    A cell for each diagonal: row i of the alignment reads text[i + low + d] at diagonal d.
    """
    n, m, width = len(item), len(text), 2 * (k + 1)
    far = k + 1
    place = np.arange(width)
    begin = low + place  # where the stretch starts if row 0 is entered at this diagonal
    row = np.where((begin >= 0) & (begin <= m), 0, far)
    start = np.clip(begin, 0, m)
    padded = np.full(n + width + 1, np.iinfo(np.int64).max, np.int64)
    lo, hi = max(0, low), min(m, low + n + width)
    if hi > lo:
        padded[lo - low : hi - low] = text[lo:hi]
    drop, origin = np.empty(width, np.int64), np.empty(width, np.int64)
    for i in range(n):
        at = i + 1 + low + place  # text characters read after this row
        drop[:-1], origin[:-1] = row[1:] + 1, start[1:]  # the item's character is left out
        drop[-1], origin[-1] = far, 0
        swap = row + (padded[i : i + width] != item[i])
        take = swap <= drop
        best, origin = np.where(take, swap, drop), np.where(take, start, origin)
        outside = (at < 0) | (at > m)
        best[outside] = far
        run = best - place  # an inserted text character costs one more than the cell to its left
        least = np.minimum.accumulate(run)
        from_ = np.maximum.accumulate(np.where(run == least, place, 0))
        row, start = np.where(outside, far, np.minimum(least + place, far)), origin[from_]
        if row.min() >= far:
            return None
    end = int(np.argmin(row))
    return (int(row[end]), int(start[end]), n + low + end) if row[end] <= k else None


def scan(texts: list[str], items: Items) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) of every text and item with a region within the budget."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    pieces, owner, shift = [], [], []
    overlap = 2 * items.longest
    for i, t in enumerate(texts):
        for lo in range(0, max(1, len(t)), SEGMENT):
            pieces.append(t[lo : lo + SEGMENT + overlap])
            owner.append(i)
            shift.append(lo)
    lens = np.array([len(p) for p in pieces], np.int64)
    ends = np.cumsum(lens)
    lo = 0
    while lo < len(pieces):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SEGMENT, side="right")))
        code = codes("".join(pieces[lo:hi]))
        off = np.concatenate(([0], np.cumsum(lens[lo:hi])))
        for q in items.by_q:
            for piece, item, start, end, edits in _stretch(code, off, q, items):
                key = (owner[lo + piece], item)
                found = (edits, start + shift[lo + piece], end + shift[lo + piece])
                if key not in best or found < best[key]:
                    best[key] = found
        lo = hi
    return [(i, item, s, e, d) for (i, item), (d, s, e) in sorted(best.items())]


def _stretch(code: np.ndarray, off: np.ndarray, q: int, items: Items) -> Iterator[tuple[int, int, int, int, int]]:
    h = grams(code, q)
    table_, head, item, at, slots, classes = items.by_q[q]
    hit = np.flatnonzero(slots[(h & U64(SLOTS - 1)).astype(np.int64)])
    if not len(hit):
        return
    j = np.searchsorted(table_, h[hit])
    j[j == len(table_)] = 0
    same = table_[j] == h[hit]
    hit, j = hit[same], j[same]
    piece = np.searchsorted(off, hit, side="right") - 1
    inside = hit + q <= off[piece + 1]
    hit, j, piece = hit[inside], j[inside], piece[inside]
    use = np.zeros(len(hit), bool)
    for width, least in classes:  # hits with `least` hits in some stretch of `width` around them
        if len(hit) < least:
            continue
        first = np.flatnonzero((hit[least - 1 :] - hit[: len(hit) - least + 1] <= width) & (piece[least - 1 :] == piece[: len(hit) - least + 1]))
        change = np.zeros(len(hit) + 1, np.int64)
        np.add.at(change, first, 1)
        np.add.at(change, first + least, -1)
        use |= np.cumsum(change[:-1]) > 0
    hit, j, piece = hit[use], j[use], piece[use]
    for part in np.array_split(np.arange(len(hit)), max(1, len(hit) // 20_000)):  # pieces stay whole below
        if not len(part):
            continue
        lo, hi = part[0], part[-1] + 1
        lo = int(np.searchsorted(piece, piece[lo], side="left"))
        if hi < len(hit):
            hi = int(np.searchsorted(piece, piece[hi], side="left"))
        if hi > lo:
            yield from _bands(code, off, hit[lo:hi], j[lo:hi], piece[lo:hi], head, item, at, items)


def _bands(code, off, hit, j, piece, head, item, at, items) -> Iterator[tuple[int, int, int, int, int]]:
    """Bands of the hits that reach their item's bound, verified. A q-gram of many items is expanded in ranges of items."""
    many = head[j + 1] - head[j]
    ranges = max(1, -(-int(many.sum()) // EXPANDED))
    edges = [len(items.rows) * r // ranges for r in range(ranges + 1)]
    if ranges == 1:
        yield from _band_range(code, off, hit, head[j], many, piece, item, at, items)
        return
    own = np.unique(j)
    pair = np.concatenate([np.int64(g) * len(items.rows) + item[head[g] : head[g + 1]] for g in own])  # ascends
    first = np.concatenate([np.arange(head[g], head[g + 1]) for g in own])
    first = np.append(first, -1)
    for lo, hi in zip(edges, edges[1:]):
        a, b = (np.searchsorted(pair, j * len(items.rows) + e) for e in (lo, hi))
        some = b > a
        if some.any():
            yield from _band_range(code, off, hit[some], first[a[some]], (b - a)[some], piece[some], item, at, items)


def _band_range(code, off, hit, first, many, piece, item, at, items) -> Iterator[tuple[int, int, int, int, int]]:
    flat = np.repeat(first - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
    who, where = item[flat], at[flat]
    diagonal = np.repeat(hit - off[piece], many) - where + items.n[who]  # >= 0
    step = items.k[who] + 1
    band = diagonal // step
    rows = np.repeat(piece, many)
    who2, rows2, band2 = np.concatenate((who, who)), np.concatenate((rows, rows)), np.concatenate((band, band - 1))
    by = np.lexsort((band2, who2, rows2))
    w, r, b = who2[by], rows2[by], band2[by]
    new = np.flatnonzero(np.concatenate(([True], (w[1:] != w[:-1]) | (r[1:] != r[:-1]) | (b[1:] != b[:-1]))))
    count = np.diff(np.concatenate((new, [len(w)])))
    for x in new[count >= items.bound[w[new]]]:
        i, p, k = int(w[x]), int(r[x]), int(items.k[w[x]])
        low = int(b[x]) * (k + 1) - int(items.n[i])  # the band's first diagonal
        found = verify(items.code[i], code[off[p] : off[p + 1]], low, k)
        if found:
            yield p, i, found[1], found[2], found[0]


def item_blocks(benchmark: DataFrame, budget: float, q: int, block_bytes: int, least: int) -> Iterator[Items]:
    """The benchmark as blocks of at most about block_bytes."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    n = rows.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    blocks = max(1, -(-int(n) // block_bytes))
    for b in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else rows
        yield Items([(r["item_id"], normal(r["text"])) for r in own.collect()], budget, q, least)


def batches_of(batch: pa.RecordBatch, column: str, most: int = 1 << 22) -> Iterator[tuple[int, list[str]]]:
    """(first row, normalised texts) in pieces of bounded size."""
    texts, first, held = [], 0, 0
    for i, t in enumerate(batch[column]):
        t = normal(t.as_py())
        if texts and held + len(t) > most:
            yield first, texts
            texts, first, held = [], i, 0
        texts.append(t)
        held += len(t)
    yield first, texts


def contaminated(docs: DataFrame, benchmark: DataFrame, budget: float = 0.05, q: int = 12, block_bytes: int = 4 << 20, least: int = LEAST) -> DataFrame:
    """doc_id, item_id, start, end, edits for each text and item that meet."""
    spark = docs.sparkSession
    found = None
    for items in item_blocks(benchmark, budget, q, block_bytes, least):
        shared = spark.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            items = shared.value
            for batch in batches:
                ids = batch["doc_id"].to_pylist()
                for first, texts in batches_of(batch, "text"):
                    rows = [{"doc_id": ids[first + i], "item_id": items.rows[j][0], "start": s, "end": e, "edits": d} for i, j, s, e, d in scan(texts, items)]
                    yield pa.RecordBatch.from_pylist(rows, HITS_ARROW)

        own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, HITS)
        found = own if found is None else found.union(own)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, budget: float = 0.05, q: int = 12, block_bytes: int = 4 << 20, least: int = LEAST) -> DataFrame:
    """The rows of docs, all columns, that meet no item."""
    spark = docs.sparkSession
    for items in item_blocks(benchmark, budget, q, block_bytes, least):
        shared = spark.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            items = shared.value
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for first, texts in batches_of(batch, "text"):
                    for hit in scan(texts, items):
                        keep[first + hit[0]] = False
                yield batch.filter(pa.array(keep))
            batch = texts = None
            give_back()

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    return materialize(contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")), "contaminated")
