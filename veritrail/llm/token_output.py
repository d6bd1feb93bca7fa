"""Token-ID output: texts to ids of a public tokenizer, to files of the context-mixing coder, and back.

Documents are range-partitioned by doc_id; each task encodes its documents, appends the end id
to each and writes one file. The files, in order, are one stream of ids; a document's start is
the number of ids before it: those of earlier files, by a running sum over one row a file, and those
before it in its own file, known when the file is read back.

Words come back often, so a text is cut at single spaces between two other characters, where
the tokenizer's own splitting always cuts, and the ids of each piece are kept, up to a bound.
Pieces are compared by 128 hash bits.

Defined cases: a null or empty text is the end id alone; a null doc_id comes first; rows that share a
doc_id stand in the order of a hash of their texts, so that they may be dealt to several files; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrail.llm import token_coder
from veritrail.llm.common import U64, give_back, materialize, new_path, slices, table, text_size, utf8, word_hashes

FILES = "part int, path string, n_docs long, n_tokens long"
FILES_ARROW = pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"
READ_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
#: Pieces whose ids a worker keeps; beyond, it forgets those that came but once.
KEEP = 800_000
JOINED = 1 << 16
BATCH = 1000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def wide_gaps(raw: np.ndarray) -> np.ndarray:
    """Where white space of more than one byte begins."""
    if not len(raw) or raw.max() < 128:
        return np.zeros(0, np.int64)
    padded = np.concatenate((raw, np.zeros(2, np.uint8)))
    at = np.flatnonzero((raw == 0xC2) | (raw == 0xE1) | (raw == 0xE2) | (raw == 0xE3))
    a, b, c = raw[at], padded[at + 1], padded[at + 2]
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    general = (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
    other = ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    return at[two | general | other]


def piece_starts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of the pieces: of each text, and each space between two characters that are no white space.

    There the tokenizer always cuts: no token of it goes from another character into a space.
    Texts with white space of more than one byte stay whole.
    """
    n = len(raw)
    space = np.flatnonzero(raw == 32)
    space = space[(space > 0) & (space < n - 1)]
    space = space[(raw[space - 1] > 32) & (raw[space + 1] > 32) & (raw[space - 1] != 127) & (raw[space + 1] != 127)]
    row = np.searchsorted(off, space, side="right") - 1
    inside = (space > off[row]) & (space < off[row + 1] - 1)
    odd = np.unique(np.searchsorted(off, wide_gaps(raw), side="right") - 1)
    space = space[inside & ~np.isin(row, odd)]
    full = off[:-1][np.diff(off) > 0]
    return np.sort(np.concatenate((full, space)))


class Encoder:
    """Ids of texts, as the tokenizers library gives them. Pieces are known by two 64-bit hashes."""

    keep = KEEP

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would keep memory of their own
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.opens = np.zeros(self.size, bool)  # ids that begin with a space
        for token, i in self.tokenizer.get_vocab().items():
            self.opens[i] = token.startswith("Ġ")
        self._clear()

    def _clear(self) -> None:
        self.h1, self.h2 = np.zeros(0, U64), np.zeros(0, U64)  # sorted by h1
        self.at, self.n = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.int32)
        self.used = np.zeros(0, bool)  # found again since they were last looked through

    def _forget(self) -> None:
        """Only pieces that were found again stay; if they are too many, none."""
        own = np.flatnonzero(self.used)
        if 4 * len(own) > 3 * self.keep:
            return self._clear()
        self.h1, self.h2, self.n = self.h1[own], self.h2[own], self.n[own]
        to = np.cumsum(self.n, dtype=np.int64)
        self.ids = self.ids[np.arange(to[-1] if len(to) else 0) + np.repeat(self.at[own] - to + self.n, self.n)]
        self.at, self.used = to - self.n, np.zeros(len(own), bool)

    def _flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found, lo = [np.zeros(0, np.int32)], 0
        while lo < len(texts):  # the library's results are large: few at a time
            hi, held = lo, 0
            while hi < len(texts) and hi - lo < BATCH and held < JOINED:
                held += len(texts[hi])
                hi += 1
            found += [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts[lo:hi], add_special_tokens=False)]
            lo = hi
        return np.concatenate(found), np.array([len(f) for f in found[1:]], np.int32)

    def _blocks(self, whole: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of about JOINED bytes of what stands end to end, cut at the edges `whole`."""
        cut = whole[np.unique(np.searchsorted(whole, np.arange(0, whole[-1] + JOINED, JOINED).clip(0, whole[-1])))]
        return list(zip(cut[:-1].tolist(), cut[1:].tolist()))

    def _in_order(self, pieces: int, *found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number) of all pieces from (pieces, ids, numbers) of some of them each."""
        n, at, before = np.empty(pieces, np.int32), np.empty(pieces, np.int64), 0
        for own, ids, counts in found:
            n[own], at[own] = counts, before + np.cumsum(counts) - counts
            before += len(ids)
        ids = np.concatenate([ids for _, ids, _ in found])
        to = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))
        return ids[np.arange(to[-1]) + np.repeat(at - to[:-1], n)], n

    def _words(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that are a space and a word: end to end, as their first ids tell them apart."""
        size = end - start
        whole = np.concatenate(([0], np.cumsum(size)))
        joined = raw[np.arange(whole[-1]) + np.repeat(start - whole[:-1], size)].tobytes()
        ids, _ = self._flat([joined[a:b].decode() for a, b in self._blocks(whole)])
        first = np.flatnonzero(self.opens[ids])
        if len(first) != len(start):
            return self._flat([joined[a:b].decode() for a, b in zip(whole[:-1].tolist(), whole[1:].tolist())])
        return ids, np.diff(np.concatenate((first, [len(ids)]))).astype(np.int32)

    def _encode(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number for each piece) of some pieces."""
        spaces = np.concatenate(([0], np.cumsum(raw == 32)))
        word = (raw[start] == 32) & (spaces[end] - spaces[start] == 1) & (raw[end - 1] > 32) & (raw[end - 1] < 127)
        a, b = np.flatnonzero(word), np.flatnonzero(~word)
        ids_a, n_a = self._words(raw, start[a], end[a]) if len(a) else (np.zeros(0, np.int32), np.zeros(0, np.int32))
        data = raw.tobytes()
        ids_b, n_b = self._flat([data[s:e].decode() for s, e in zip(start[b].tolist(), end[b].tolist())])
        return self._in_order(len(start), (a, ids_a, n_a), (b, ids_b, n_b))

    def _pieces(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces that are encoded by themselves."""
        start = piece_starts(raw, off)
        return start, np.concatenate((start[1:], [len(raw)])).astype(np.int64) if len(start) else start

    def _distinct(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of each piece among the distinct ones, bytes of these end to end, their edges)."""
        if (end[:-1] != start[1:]).any():  # what stands between words goes
            step = np.zeros(len(raw) + 1, np.int8)
            step[start] += 1
            step[end] -= 1
            raw = raw[np.cumsum(step[:-1], dtype=np.int8).view(bool)]
            edges = np.concatenate(([0], np.cumsum(end - start)))
        else:
            edges = np.concatenate((start, end[-1:]))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])
        found = pieces.dictionary_encode()
        _, edges, data = found.dictionary.buffers()
        return found.indices.to_numpy(), np.frombuffer(data, np.uint8), np.frombuffer(edges, np.int64)[: len(found.dictionary) + 1]

    def encode(self, raw: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by the end id; their number for each text) from UTF-8 and offsets."""
        start, end = self._pieces(raw, off)
        if not len(start):
            return np.full(len(off) - 1, end_id, np.int32), np.ones(len(off) - 1, np.int64)
        group, own, edges = self._distinct(raw, start, end)
        own, a, b = own[: edges[-1]], edges[:-1], edges[1:]
        h1, h2 = word_hashes(own, a, b, 11), word_hashes(own, a, b, 12)
        if len(self.h1) > self.keep:
            self._forget()
        by = np.argsort(h1, kind="stable")
        s1, s2 = h1[by], h2[by]
        place = np.searchsorted(self.h1, s1)
        place[place == len(self.h1)] = 0
        known = (self.h1[place] == s1) & (self.h2[place] == s2) if len(self.h1) else np.zeros(len(by), bool)
        if not known.all():
            fresh = by[~known]
            ids, n = self._encode(own, a[fresh], b[fresh])
            keys = np.concatenate((self.h1, h1[fresh]))
            order = np.argsort(keys, kind="stable")
            at = len(self.ids) + np.cumsum(n, dtype=np.int64) - n
            self.h1, self.h2 = keys[order], np.concatenate((self.h2, h2[fresh]))[order]
            self.at, self.n = np.concatenate((self.at, at))[order], np.concatenate((self.n, n))[order]
            self.ids = np.concatenate((self.ids, ids))
            self.used = np.concatenate((self.used, np.zeros(len(fresh), bool)))[order]
            place = np.searchsorted(self.h1, s1)
        self.used[place[known]] = True
        at, n = np.empty(len(by), np.int64), np.empty(len(by), np.int64)
        at[by], n[by] = self.at[place], self.n[place]
        ids = self.ids
        clash = by[self.h2[place] != s2]  # another piece with the same first hash
        if len(clash):
            more, m = self._encode(own, a[clash], b[clash])
            at[clash], n[clash] = len(ids) + np.cumsum(m, dtype=np.int64) - m, m
            ids = np.concatenate((ids, more))
        at, n = at[group], n[group]
        total = np.concatenate(([0], np.cumsum(n)))
        first = np.searchsorted(start, off)  # of each text, its first piece
        counts = np.diff(total[first]) + 1
        inside = np.ones(int(counts.sum()), bool)
        inside[np.cumsum(counts) - 1] = False
        out = np.full(len(inside), end_id, np.int32)
        out[inside] = ids[np.arange(total[-1]) + np.repeat(at - total[:-1], n)]
        return out, counts


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def writer(folder: str, vocabulary: str, end: int):
    def run(batches):
        from pyspark import TaskContext

        give_back("token writer")  # what earlier stages left in this worker
        coder, ids, counts, doc_ids = encoder(vocabulary), [], [], []
        for batch in batches:
            raw, off = utf8(batch["text"])
            for lo, hi in slices(off, 2_000_000):
                i, n = coder.encode(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], end)
                ids.append(i)
                counts.append(n)
            doc_ids.append(batch["doc_id"].to_numpy(zero_copy_only=False))
        if not doc_ids or not sum(map(len, doc_ids)):
            return
        ids, counts, doc_ids = np.concatenate(ids), np.concatenate(counts), np.concatenate(doc_ids)
        path = f"{folder}/{uuid.uuid4().hex}.vtk"
        where, name = fs.FileSystem.from_uri(path)
        where.create_dir(name.rpartition("/")[0], recursive=True)
        with where.open_output_stream(name, compression=None) as out:
            token_coder.write_file(out, ids, doc_ids, counts, coder.size)
        row = {"part": TaskContext.get().partitionId(), "path": path, "n_docs": len(doc_ids), "n_tokens": len(ids)}
        yield pa.RecordBatch.from_pylist([row], FILES_ARROW)

    return run


def reader(batches):
    give_back("token reader")
    for batch in batches:
        for r in batch.to_pylist():
            where, name = fs.FileSystem.from_uri(r["path"])
            with where.open_input_file(name) as source:
                ids, doc_ids, counts = token_coder.read_file(source)
            raw = memoryview(ids.astype("<u4").tobytes())
            cut = np.concatenate(([0], np.cumsum(counts)))
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
            for lo in range(0, len(doc_ids), 10_000):
                own = slice(lo, lo + 10_000)
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids[own]), pa.array(cut[:-1][own] + r["start"]), pa.array(counts[own]), pa.array(crc[own], pa.int64())], schema=READ_ARROW)


NO_ID = -(2**63)


def write_tokens(docs: DataFrame, folder: str, vocabulary: str | None = None, end: int = 0, file_bytes: int = 8 << 20) -> DataFrame:
    """Write docs (doc_id, text) as token files; one row a file: path, start, n_docs, n_tokens."""
    _, n_bytes = text_size(docs)
    parts = max(12, -(-n_bytes // file_bytes))
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.withColumn("place", F.xxhash64("text"))
    dealt = own.repartitionByRange(parts, "doc_id", "place").sortWithinPartitions("doc_id", "place", "text").drop("place")
    files = materialize(dealt.mapInArrow(writer(folder, vocabulary or default_vocabulary(), end), FILES), "token-files")
    # a running sum over files: ranges of 1024 parts, then the parts of a range
    ranged = files.withColumn("range", F.floor(F.col("part") / 1024))
    before = ranged.groupBy("range").agg(F.sum("n_tokens").alias("own")).select("range", (F.sum("own").over(Window.orderBy("range")) - F.col("own")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("range").orderBy("part")) - F.col("n_tokens")
    return materialize(ranged.join(F.broadcast(before), "range").select("path", (F.col("before") + inside).alias("start"), "n_docs", "n_tokens"), "token-starts")


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    n = max(1, files.count())
    out = files.repartition(n, "path").mapInArrow(reader, READ)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def op3_token_output(spark, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), new_path(spark, "tokens")))
