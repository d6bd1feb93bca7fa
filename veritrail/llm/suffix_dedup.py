"""Suffix-array dedup: distributed prefix doubling over byte positions.

A rank names the `length` bytes from a position on. Ranks of a first length come from sorting
Rabin-Karp fingerprints. Each further round pairs the rank at p with the rank at p + offset, at
growing offsets; Spark deals the pairs to buckets by the first rank, a bucket sorts the pairs of
all chunks, equal pairs share a rank, and positions whose rank is unique drop out. The last
round sorts the pairs that stand for `threshold` bytes: positions still there share all of them.

Rows for single positions would need many times the disk allowed, so a row carries the sorted,
distinct pairs of one chunk for one bucket (exchange.py). Two filters keep positions out that
can't repeat, or needn't be ranked:

* Anchors: of each `threshold`-byte string, the first-length strings in it with the least
  fingerprint. Equal strings have equal anchors, so a string whose anchor stands in one document
  alone is in one document alone.
* Whole copies, found by two 64-bit hashes and the length of the text: every string of a copy
  also starts in the first of its texts. A join finds them at any number; chunks learn theirs.

Bytes go that lie in a `threshold`-byte string which also starts in a document of a smaller
doc_id. Fingerprints are 52-bit names of the first length; two different strings are taken as
equal only if each part of first length in them is equal or has an equal name.

Defined cases: a null text is empty; a null doc_id counts as the smallest; rows that share a
doc_id are one document and don't repeat each other; shorter texts stay whole; a text longer
than a slice is worked through in overlapping slices; an empty table gives an empty result;
other columns are not read. What is left may split a character, so it is binary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm import exchange as X
from veritrail.llm.common import INVERSE, U64, byte_table, chunk_bounds, materialize, measured, mix, pieces, powers, prefix_hash, range_chunk, table, utf8, with_chunks

SCHEMA = "doc_id long, kept binary, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>"
ARROW = pa.schema([("doc_id", pa.int64()), ("kept", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
NAME = U64(12)  # bits of a fingerprint that its name leaves out
NONE = U64(2**64 - 1)
SLICE = 1 << 20


def lengths(threshold: int) -> list[int]:
    """First length (at most 32) and its doublings up to the threshold."""
    out = [threshold]
    while out[0] > 32:
        out.insert(0, -(-out[0] // 2))
    return out if len(out) > 1 else [-(-threshold // 2), threshold]


def sliding(f: np.ufunc, a: np.ndarray, width: int) -> np.ndarray:
    """f over each run of `width`; width - 1 shorter than a."""
    size = 1
    while size * 2 <= width:
        a = f(a[:-size], a[size:])
        size *= 2
    return f(a[: len(a) - (width - size)], a[width - size :]) if width > size else a


class Anchors:
    """A slice: the least code of first length in each string of threshold bytes, and where these stand."""

    def __init__(self, raw: np.ndarray, edges: np.ndarray, count: int, short: int, long: int, shift: int):
        n = len(raw)
        self.width, self.n = long - short + 1, n
        self.at, self.valid, self.least, self.code = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, U64), np.zeros(0, U64)
        if n < long:
            return
        end = np.repeat(edges[1:], np.diff(edges))
        place = np.arange(n)
        self.code = np.full(n, NONE, U64)
        sums = prefix_hash(byte_table(3)[raw])
        self.code[: n - short + 1] = mix((sums[short:] - sums[:-short]) * powers(INVERSE, n - short + 1)) >> U64(shift) << U64(shift)
        self.code[place + short > end] = NONE
        self.valid = (place + long <= end)[: n - long + 1]
        self.valid[count:] = False  # of the next slice
        self.least = sliding(np.minimum, self.code, self.width)[: n - long + 1]
        top = np.zeros(n + self.width - 1, U64)
        top[self.width - 1 : self.width - 1 + len(self.least)] = np.where(self.valid, self.least, U64(0))
        self.at = np.flatnonzero((sliding(np.maximum, top, self.width) == self.code) & (self.code != NONE))

    def candidates(self, repeated: np.ndarray) -> np.ndarray:
        """Starts of the strings whose anchor repeats; repeated: for each anchor."""
        if not len(self.at):
            return np.zeros(0, np.int64)
        code = np.full(self.n, NONE, U64)
        hit = self.at[repeated]
        code[hit] = self.code[hit]
        return np.flatnonzero(self.valid & (sliding(np.minimum, code, self.width)[: len(self.least)] == self.least))


def shifted(mask: np.ndarray, by: int) -> np.ndarray:
    """mask, and what stands `by` behind each set place."""
    out = mask.copy()
    out[by:] |= mask[: max(0, len(mask) - by)]
    return out


def before(mask: np.ndarray, by: int) -> np.ndarray:
    """mask, and what stands `by` ahead of each set place."""
    out = mask.copy()
    out[: max(0, len(mask) - by)] |= mask[by:]
    return out


class Level:
    """Ranks of one length over a chunk: places, the rank of each among the chunk's own, documents of each rank."""

    def __init__(self, keys: np.ndarray, at: np.ndarray, doc: np.ndarray):
        self.at = at
        self.own, size = X.group(keys)
        self.keys = np.empty(len(size), keys.dtype)
        self.keys[self.own] = keys
        self.first, self.final = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
        self.final[self.own] = doc  # places ascend: the last one stays
        self.first[self.own[::-1]] = doc[::-1]

    def learn(self, other: np.ndarray, ranks: np.ndarray) -> None:
        """other: which ranks other chunks have; ranks: what these are called there."""
        self.other, self.global_rank = other, np.zeros(len(other), U64)
        self.global_rank[other] = ranks

    def unique(self) -> np.ndarray:
        """Places whose string no second document has."""
        return self.at[(~self.other & (self.first == self.final))[self.own]]


class Chunk:
    def __init__(self, docs: pa.Table, lens: list[int], shift: int):
        self.shift = shift
        self.docs = docs.sort_by([("doc_id", "ascending"), ("h1", "ascending"), ("h2", "ascending")])
        self.lens, self.offsets = lens, [b - a for a, b in zip(lens, lens[1:])]
        self.copies = np.zeros(self.docs.num_rows, bool)

    def leave_out(self, copies: np.ndarray) -> None:
        self.copies = copies
        rest = self.docs.filter(pa.array(~copies)) if copies.any() else self.docs
        self.raw, self.off = utf8(rest["text"])
        ids = rest["doc_id"].to_numpy()
        self.number = np.cumsum(np.concatenate(([0], ids[1:] != ids[:-1]))) if len(ids) else np.zeros(0, np.int64)
        self.pieces = pieces(self.off, SLICE, self.lens[-1] - 1)

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return self.number[np.searchsorted(self.off, at, side="right") - 1]

    def anchors(self, start: int, count: int, edges: np.ndarray) -> Anchors:
        return Anchors(self.raw[start : start + edges[-1]], edges, count, self.lens[0], self.lens[-1], self.shift)

    def anchor_codes(self) -> tuple[np.ndarray, np.ndarray]:
        """Codes and places of all anchors."""
        found = [(a.code[a.at], a.at + piece[0]) for piece in self.pieces for a in [self.anchors(*piece)]]
        return (np.concatenate([c for c, _ in found]), np.concatenate([p for _, p in found])) if found else (np.zeros(0, U64), np.zeros(0, np.int64))

    def candidates(self, elsewhere: np.ndarray) -> np.ndarray:
        """Mask of the strings whose anchor a second document has; elsewhere: for each distinct code."""
        code, at = self.anchor_codes()
        level = Level(code, at, self.doc_of(at))
        repeated = (elsewhere | (level.first != level.final))[level.own] if len(code) else np.zeros(0, bool)
        mask, lo = np.zeros(len(self.raw), bool), 0
        for piece in self.pieces:
            a = self.anchors(*piece)
            mask[piece[0] + a.candidates(repeated[lo : lo + len(a.at)])] = True
            lo += len(a.at)
        return mask

    def needed(self, alive: np.ndarray, round_: int) -> np.ndarray:
        """Places whose rank of round_ the strings in alive are made of."""
        for by in reversed(self.offsets[round_:]):
            alive = shifted(alive, by)
        return np.flatnonzero(alive)

    def names(self, at: np.ndarray) -> np.ndarray:
        short, out = self.lens[0], np.empty(len(at), U64)
        for start, count, edges in self.pieces:
            lo, hi = np.searchsorted(at, (start, start + count))
            if hi > lo:
                here = at[lo:hi] - start
                sums = prefix_hash(byte_table(3)[self.raw[start : start + edges[-1]]])
                out[lo:hi] = mix((sums[here + short] - sums[here]) * powers(INVERSE, int(edges[-1]) + 1)[here])
        return out >> NAME << NAME

    def first_level(self, alive: np.ndarray) -> Level:
        at = self.needed(alive, 0)
        return Level(self.names(at), at, self.doc_of(at))

    def next_level(self, level: Level, alive: np.ndarray, round_: int) -> tuple[Level, np.ndarray, np.ndarray]:
        """The level of the pairs at the next offset; which of its ranks other chunks may have, and their first and second halves."""
        at, by = self.needed(alive, round_), self.offsets[round_ - 1]
        index = np.full(len(self.raw), -1, np.int32)
        index[level.at] = np.arange(len(level.at), dtype=np.int32)
        most = len(level.keys)
        pairs = Level(level.own[index[at]] * most + level.own[index[at + by]], at, self.doc_of(at))
        left, right = pairs.keys // max(most, 1), pairs.keys % max(most, 1)
        asked = level.other[left] & level.other[right]
        return pairs, asked, np.stack((level.global_rank[left[asked]], level.global_rank[right[asked]]))

    def survivors(self, alive: np.ndarray, level: Level, round_: int) -> np.ndarray:
        """alive without the strings that hold a string which no second document has."""
        gone = np.zeros(len(self.raw), bool)
        gone[level.unique()] = True
        for by in reversed(self.offsets[round_:]):
            gone = before(gone, by)
        return alive & ~gone


def spread(bits: np.ndarray, asked: np.ndarray) -> np.ndarray:
    out = np.zeros(len(asked), bool)
    out[asked] = bits
    return out


def tasks(lens: list[int], buckets: int, shift: int):
    bucket_bits = max(1, (buckets - 1).bit_length())
    index_bits = (64 - bucket_bits) // 2

    def first(docs: pa.Table, notes: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return X.REQUEST_ARROW.empty_table()
        chunk = Chunk(docs, lens, shift)
        known = set(zip(*(notes[c].to_pylist() for c in ("doc_id", "h1", "h2"))))
        rows = zip(*(chunk.docs[c].to_pylist() for c in ("doc_id", "h1", "h2")))
        chunk.leave_out(np.fromiter((r in known for r in rows), bool, chunk.docs.num_rows))
        number = docs["chunk"][0].as_py()
        return pa.concat_tables([X.forward(number, 0, chunk.copies), X.requests(number, X.distinct(chunk.anchor_codes()[0]), buckets)])

    def second(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return X.REQUEST_ARROW.empty_table()
        chunk, number = Chunk(docs, lens, shift), docs["chunk"][0].as_py()
        chunk.leave_out(X.kept_bits(replies)[0])
        alive = chunk.candidates(X.bits(X.asked_now(replies), "other"))
        keys = chunk.first_level(alive).keys
        return pa.concat_tables([X.forward(number, 0, chunk.copies), X.forward(number, 1, alive), X.requests(number, keys, buckets)])

    def replay(docs: pa.Table, kept: list[np.ndarray], ranks: np.ndarray | None):
        """The chunk after the rounds of which the answers are known: its level, what it asks and the pairs asked for.

        kept: copies, strings alive, and for each round which of the ranks asked for other chunks have.
        ranks: of the last round; those of earlier rounds aren't needed again, for they don't change the order.
        """
        chunk = Chunk(docs, lens, shift)
        chunk.leave_out(kept[0])
        alive, learnt = kept[1], kept[2:]
        level, asked, pairs = chunk.first_level(alive), None, None
        for round_, other in enumerate(learnt, 1):
            level.learn(other if asked is None else spread(other, asked), ranks if round_ == len(learnt) and ranks is not None else U64(0))
            alive = chunk.survivors(alive, level, round_ - 1)
            level, asked, pairs = chunk.next_level(level, alive, round_)
        return chunk, level, asked, pairs

    def next_round(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return X.REQUEST_ARROW.empty_table()
        number, now = docs["chunk"][0].as_py(), X.asked_now(replies)
        kept = [*X.kept_bits(replies), X.bits(now, "other")]
        _, _, _, (left, right) = replay(docs, kept, X.ranks(now, index_bits))
        mask = U64((1 << index_bits) - 1)
        keys = (left & mask) << U64(bucket_bits + index_bits) | right
        at = np.searchsorted(left >> U64(index_bits), np.arange(buckets + 1, dtype=U64))
        return pa.concat_tables([*(X.forward(number, i, f) for i, f in enumerate(kept)), X.requests(number, keys, buckets, at=at)])

    def last(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return ARROW.empty_table()
        kept = X.kept_bits(replies)
        chunk, level, asked, _ = replay(docs, kept, None)
        drop = level.first.copy()  # strings of a rank go from all documents but the first
        earlier = spread(X.bits(X.asked_now(replies), "earlier"), asked)
        drop[earlier] = -1
        at = level.at[chunk.doc_of(level.at) > drop[level.own]] if len(level.at) else level.at
        change = np.zeros(len(chunk.raw) + 1, np.int32)
        change[at] += 1
        change[at + lens[-1]] -= 1
        gone = np.cumsum(change[:-1]) > 0
        raw, off, live = chunk.raw, chunk.off, iter(range(len(chunk.off) - 1))
        left, spans, sizes, removed = [], [], [], []
        for copy, text in zip(chunk.copies, chunk.docs["text"]):
            if copy:
                n = len(text.as_py().encode())
                sizes.append(n), removed.append(n), left.append(b""), spans.append([{"start": 0, "end": n}])
                continue
            i = next(live)
            own, g = raw[off[i] : off[i + 1]], gone[off[i] : off[i + 1]]
            edge = np.flatnonzero(np.diff(np.concatenate(([0], g.view(np.int8), [0]))))
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])])
            sizes.append(len(own)), removed.append(int(np.count_nonzero(g))), left.append((own[~g] if len(edge) else own).tobytes())
        arrays = [chunk.docs["doc_id"].combine_chunks(), pa.array(left, pa.binary()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, ARROW.field("spans").type)]
        return pa.Table.from_arrays(arrays, schema=ARROW)

    return [first, second, *[next_round] * (len(lens) - 1)], last, 1 << index_bits


def hashes() -> list:
    text = F.col("text").cast("string")
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), F.octet_length(text), text).alias("h2")]


def whole_copies(sizes: DataFrame, threshold: int) -> DataFrame:
    """(doc_id, h1, h2) of the rows whose text a smaller doc_id has too."""
    own = sizes.where(F.col("size") >= threshold).select("doc_id", "h1", "h2")
    first = own.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("final")).where("first < final")
    return own.join(first, ["h1", "h2"]).where("doc_id > first").select("doc_id", "h1", "h2").distinct()


def suffix_dedup(docs: DataFrame, threshold: int = 50, chunk_bytes: int = 4 << 20, bucket_bytes: int = 12 << 20) -> DataFrame:
    """doc_id, kept (bytes), n_bytes, n_removed, spans (of removed bytes) of every row. docs needs doc_id and text; threshold is at least 2."""
    sizes = measured(docs, *hashes())
    bounds, n_bytes = chunk_bounds(sizes, chunk_bytes)
    copies = whole_copies(sizes, threshold)
    notes = materialize(copies.withColumn("chunk", range_chunk(F.col("doc_id"), bounds).cast("int")), "suffix-copies")
    buckets = max(24, -(-n_bytes // bucket_bytes))
    lens = lengths(threshold)
    # bits of an anchor's code: few more than tell all anchors apart, so that false candidates stay rare at any
    # size. Anchors are the least of many codes, so they crowd in the lower part of the range: 4 bits for that.
    shift = 64 - max(24, (n_bytes // 12).bit_length() + 8 + 4)
    steps, last, most = tasks(lens, buckets, shift)
    out = X.rounds(with_chunks(docs, bounds, *hashes()), len(bounds) + 1, buckets, steps, [shift] + [None] * (len(lens) - 1) + [0], last, SCHEMA, notes, most)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != -(2**63), F.col("doc_id")))


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
