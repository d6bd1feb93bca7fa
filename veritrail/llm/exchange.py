"""A packed key exchange: chunks ask buckets which of their keys other chunks hold as well.

Spark moves the keys, but not as a row each: a chunk sends every bucket one row with its
sorted, distinct keys, as byte planes of differences; the bucket sorts what all chunks sent
and answers with a bit (or a count) for each key. A key that millions of rows share is one
entry per chunk, so no key can heat a task. Both sides are grouped by Spark: lost tasks are
run again from their inputs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from veritrail.llm.common import give_back

U64 = np.uint64
REQUEST = "bucket int, chunk int, n long, keys binary, counts binary"
REPLY = "chunk int, bucket int, n long, other binary, earlier binary, counts binary"
REQUEST_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
REPLY_ARROW = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64()), ("other", pa.binary()), ("earlier", pa.binary()), ("counts", pa.binary())])


def pack(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as the byte planes of their differences, each compressed by itself: their statistics differ."""
    d = np.diff(keys, prepend=U64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    planes = []
    for i in range(8):
        plane = np.ascontiguousarray(d[:, i])
        small = pa.compress(plane.tobytes(), codec="zstd", asbytes=True) if plane.any() else b""
        planes.append(small if len(small) < len(plane) else plane.tobytes())
    return np.array([len(p) for p in planes], "<u4").tobytes() + b"".join(planes)


def unpack(blob: bytes, n: int) -> np.ndarray:
    d, at = np.zeros((n, 8), np.uint8), 32
    for i, size in enumerate(np.frombuffer(blob, "<u4", 8).tolist()):
        if size:
            plane = blob[at : at + size]
            d[:, i] = np.frombuffer(plane if size == n else pa.decompress(plane, decompressed_size=n, codec="zstd", asbytes=True), np.uint8)
        at += size
    return np.cumsum(d.view("<u8").ravel(), dtype=U64)


def packed_bytes(a: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(a).tobytes(), codec="zstd", asbytes=True)


def unpacked_bytes(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, decompressed_size=n, codec="zstd", asbytes=True), np.uint8)


def distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys


def cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's keys begin in the sorted keys: bucket b has the keys of [b, b + 1) * 2**64 / buckets."""
    edges = np.array([(b << 64) // buckets for b in range(buckets)], U64)
    return np.concatenate((np.searchsorted(keys, edges), [len(keys)]))


def requests(chunk: int, keys: np.ndarray, buckets: int, counts: np.ndarray | None = None, at: np.ndarray | None = None) -> pa.Table:
    """Rows for the distinct keys of one chunk, sorted in each bucket; at: where each bucket's begin, if not by the keys' own ranges."""
    at = cuts(keys, buckets) if at is None else at
    rows = []
    for b in range(buckets):
        lo, hi = int(at[b]), int(at[b + 1])
        if hi > lo:
            rows.append({"bucket": b, "chunk": chunk, "n": hi - lo, "keys": pack(keys[lo:hi]), "counts": None if counts is None else packed_bytes(counts[lo:hi])})
    return pa.Table.from_pylist(rows, REQUEST_ARROW)


def answer(asked: pa.Table, shift: int) -> pa.Table:
    """What one bucket answers: bits of the keys that another chunk has, bits of those an earlier chunk has.

    Keys are compared by their bits above `shift`. With counts, the sums over all chunks
    (at most 255) come back for each key that two or more rows have.
    """
    order = np.argsort(asked["chunk"].to_numpy(), kind="stable")
    chunk, n = asked["chunk"].to_numpy()[order], asked["n"].to_numpy()[order]
    blobs, tallies = asked["keys"], asked["counts"]
    bucket = asked["bucket"][0].as_py()
    keys = np.concatenate([unpack(blobs[int(i)].as_py(), int(k)) for i, k in zip(order, n)]) >> U64(shift)
    by = np.argsort(keys, kind="stable")  # equal keys stay in the order of their chunks
    s = keys[by]
    head = np.concatenate(([True], s[1:] != s[:-1]))
    del s, keys
    counted = tallies[0].as_py() is not None
    earlier = np.empty(len(by), bool)
    earlier[by] = ~head
    other = np.empty(len(by), bool)
    tail = np.concatenate((head[1:], [True]))
    other[by] = ~(head & tail)
    sums = None
    if counted:
        c = np.concatenate([unpacked_bytes(tallies[int(i)].as_py(), int(k)) for i, k in zip(order, n)]).astype(np.int64)
        at = np.flatnonzero(head)
        total = np.minimum(np.add.reduceat(c[by], at), 255)
        sums = np.empty(len(by), np.uint8)
        sums[by] = np.repeat(total, np.diff(np.concatenate((at, [len(by)])))).astype(np.uint8)
        other = sums >= 2
    rows, lo = [], 0
    for c, k in zip(chunk, n):
        hi = lo + int(k)
        rows.append({"chunk": int(c), "bucket": bucket, "n": int(k), "other": packed_bytes(np.packbits(other[lo:hi])), "earlier": packed_bytes(np.packbits(earlier[lo:hi])), "counts": packed_bytes(sums[lo:hi][other[lo:hi]]) if counted else None})
        lo = hi
    return pa.Table.from_pylist(rows, REPLY_ARROW)


def bits(replies: pa.Table, field: str) -> np.ndarray:
    """The answers of one chunk, in the order of its sorted keys."""
    rows = sorted(replies.select(["bucket", "n", field]).to_pylist(), key=lambda r: r["bucket"])
    parts = [np.unpackbits(unpacked_bytes(r[field], -(-r["n"] // 8)), count=r["n"]) for r in rows]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def totals(replies: pa.Table, other: np.ndarray) -> np.ndarray:
    """Counts of the keys whose bit in `other` is set."""
    rows = sorted(replies.select(["bucket", "n", "counts"]).to_pylist(), key=lambda r: r["bucket"])
    out, lo = [], 0
    for r in rows:
        k = int(other[lo : lo + r["n"]].sum())
        out.append(unpacked_bytes(r["counts"], k))
        lo += r["n"]
    return np.concatenate(out) if out else np.zeros(0, np.uint8)


def concat(tables: list[pa.Table], schema: pa.Schema) -> pa.Table:
    return pa.concat_tables(tables) if tables else schema.empty_table()


def ranked(asked: pa.Table, most: int) -> pa.Table:
    """What one bucket answers when it ranks: all keys sorted, equal keys of equal rank, ranks without gaps.

    Each chunk learns which of its keys another chunk has, and the ranks of those.
    """
    order = np.argsort(asked["chunk"].to_numpy(), kind="stable")
    chunk, n = asked["chunk"].to_numpy()[order], asked["n"].to_numpy()[order]
    keys = np.concatenate([unpack(asked["keys"][int(i)].as_py(), int(k)) for i, k in zip(order, n)])
    rank, size = group(keys)
    if len(size) > most:
        raise ValueError(f"a bucket has {len(size)} ranks of {most}: take smaller buckets")
    other = (size > 1)[rank]
    rows, lo = [], 0
    for c, k in zip(chunk, n):
        hi = lo + int(k)
        rows.append({"chunk": int(c), "bucket": asked["bucket"][0].as_py(), "n": int(k), "other": packed_bytes(np.packbits(other[lo:hi])), "earlier": None, "counts": pack(rank[lo:hi][other[lo:hi]].astype(U64))})
        lo = hi
    return pa.Table.from_pylist(rows, REPLY_ARROW)


def group(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each key among the sorted distinct keys, and how often each of these stands."""
    by = np.argsort(keys)
    s = keys[by]
    head = np.concatenate(([True], s[1:] != s[:-1])) if len(s) else np.zeros(0, bool)
    place = np.empty(len(s), np.int64)
    place[by] = np.cumsum(head) - 1
    return place, np.diff(np.concatenate((np.flatnonzero(head), [len(s)])))


def ranks(replies: pa.Table, index_bits: int) -> np.ndarray:
    """Ranks of the keys that another chunk has, in the order of the chunk's keys: bucket, then place in it."""
    out = []
    for r in sorted(replies.select(["bucket", "n", "other", "counts"]).to_pylist(), key=lambda r: r["bucket"]):
        k = int(np.unpackbits(unpacked_bytes(r["other"], -(-r["n"] // 8)), count=r["n"]).sum())
        out.append(unpack(r["counts"], k) | U64(r["bucket"] << index_bits))
    return np.concatenate(out) if out else np.zeros(0, U64)


def forward(chunk: int, number: int, flags: np.ndarray) -> pa.Table:
    """A request that comes back as it is: bits that the chunk itself learnt."""
    return pa.Table.from_pylist([{"bucket": -1 - chunk, "chunk": chunk, "n": len(flags), "keys": packed_bytes(np.packbits(flags)), "counts": bytes([number])}], REQUEST_ARROW)


def kept_bits(replies: pa.Table) -> list[np.ndarray]:
    """The forwarded bits, by number."""
    rows = [r for r in replies.to_pylist() if r["bucket"] < 0]
    rows.sort(key=lambda r: r["counts"])
    return [np.unpackbits(unpacked_bytes(r["other"], -(-r["n"] // 8)), count=r["n"]).astype(bool) for r in rows]


def asked_now(replies: pa.Table) -> pa.Table:
    return replies.filter(pa.array(replies["bucket"].to_numpy() >= 0))


def bucket_task(shift: int | None, most: int):
    """A bucket's task: it answers keys above `shift` bits, or ranks them if there is no shift."""

    def run(asked: pa.Table) -> pa.Table:
        if asked["bucket"][0].as_py() < 0:
            rows = [{"chunk": r["chunk"], "bucket": r["bucket"], "n": r["n"], "other": r["keys"], "earlier": None, "counts": r["counts"]} for r in asked.to_pylist()]
            return pa.Table.from_pylist(rows, REPLY_ARROW)
        return ranked(asked, most) if shift is None else answer(asked, shift)

    return run


DEALT = "chunk int, blob binary"
DEALT_ARROW = pa.schema([("chunk", pa.int32()), ("blob", pa.binary())])
#: Bytes of Arrow data that the dealing task gathers before it packs them by chunk.
GATHERED = 32 << 20


def closed(rows: pa.Table) -> pa.RecordBatch:
    """The rows as one compressed blob for each chunk: texts take much less room in the shuffle so."""
    rows = rows.sort_by("chunk").combine_chunks()
    chunk = rows["chunk"].to_numpy()
    cut = np.concatenate(([0], np.flatnonzero(np.diff(chunk)) + 1, [len(chunk)])) if len(chunk) else np.zeros(1, int)
    rows, blobs, codec = rows.drop_columns(["chunk"]), [], pa.Codec("zstd", compression_level=6)
    for lo, hi in zip(cut, cut[1:]):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_table(rows.slice(lo, hi - lo).combine_chunks())
        raw = sink.getvalue()
        blobs.append(raw.size.to_bytes(8, "little") + codec.compress(raw, asbytes=True))
    return pa.RecordBatch.from_arrays([pa.array(chunk[cut[:-1]], pa.int32()), pa.array(blobs, pa.binary())], schema=DEALT_ARROW)


def closing(batches):
    give_back()
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size > GATHERED:
            yield closed(pa.Table.from_batches(held))
            held, size = [], 0
    if held:
        yield closed(pa.Table.from_batches(held))
    held, batch = [], None
    give_back()


def freed(step, *tables: pa.Table) -> pa.Table:
    """What the step returns; what it freed goes back to the system."""
    try:
        return step(*tables)
    finally:
        give_back()


def opened(dealt: pa.Table, schema: pa.Schema) -> pa.Table:
    """The rows of one chunk."""
    parts, codec = [], pa.Codec("zstd")
    for blob in dealt["blob"]:
        raw = memoryview(blob.as_buffer())
        parts.append(pa.ipc.open_stream(codec.decompress(raw[8:], int.from_bytes(raw[:8], "little"))).read_all())
    rows = pa.concat_tables(parts) if parts else schema.empty_table()
    return rows.append_column("chunk", pa.array(np.full(rows.num_rows, dealt["chunk"][0].as_py() if parts else 0), pa.int32()))


def rounds(docs: DataFrame, chunks: int, buckets: int, steps: list, shifts: list[int | None], last, schema: str, notes: DataFrame | None = None, most: int = 0) -> DataFrame:
    """Alternate chunk tasks and bucket tasks over one shuffle of docs.

    docs has doc_id, text, chunk and may have more. steps[0](docs), or steps[0](docs, notes) with notes
    (chunk, ...), and steps[i](docs, replies) make requests; last(docs, replies) makes the result. The shuffle
    of docs by chunk, packed, stands in the plan once for each step, and Spark runs it once. Partition numbers
    are chunk and bucket numbers, so no two chunks meet in a task.
    """
    columns = to_arrow_schema(docs.drop("chunk").schema)
    dealt = docs.mapInArrow(closing, DEALT).repartitionById(chunks, "chunk")

    def alone(step):
        return lambda d: freed(step, opened(d, columns))

    def paired(step):
        return lambda d, other: freed(step, opened(d, columns), other)

    def answered(task):
        return lambda asked: freed(task, asked)

    own = dealt.groupBy("chunk")
    asked = own.applyInArrow(alone(steps[0]), REQUEST) if notes is None else own.cogroup(notes.repartitionById(chunks, "chunk").groupBy("chunk")).applyInArrow(paired(steps[0]), REQUEST)
    for i, shift in enumerate(shifts):
        replies = asked.repartitionById(buckets, "bucket").groupBy("bucket").applyInArrow(answered(bucket_task(shift, most)), REPLY).repartitionById(chunks, "chunk")
        step, out = (steps[i + 1], REQUEST) if i + 1 < len(steps) else (last, schema)
        asked = dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(paired(step), out)
    return asked
