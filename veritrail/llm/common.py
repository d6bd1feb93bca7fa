"""Shared pieces of the training-data operators: shared folder, tables, text to numpy."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

U64 = np.uint64

#: White space of the word rule `[^\x20\x09-\x0D]+`; everything else belongs to words.
WORD_GAP = "[ \\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only in local mode, where one machine does all the work, may it be unset: then a temporary folder is taken.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("veritrail.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="veritrail-")
        spark.conf.set("veritrail.shared.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/veritrail/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_LAST: list[str] = []


def give_back(task: str | None = None) -> None:
    """What a worker's tasks have freed goes back to the system: Spark keeps its workers, and what they hold counts against their executor.

    With the name of a task, only if this worker's last one had another name.
    """
    if task is not None and _LAST == [task]:
        return
    _LAST[:] = [task or ""]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc; elsewhere freed memory stays with the worker
    if trim is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_size(df: DataFrame, text: str = "text") -> tuple[int, int]:
    """(rows, UTF-8 bytes of the text column)."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first()
    return int(row["n"]), int(row["b"])


def measured(df: DataFrame, *more: Column) -> DataFrame:
    """Written: doc_id (null: the smallest), size (UTF-8 bytes of text), and more columns; what planning needs of the texts."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    return materialize(df.select(key.alias("doc_id"), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("size"), *more), "sizes")


def chunk_bounds(sizes: DataFrame, chunk_bytes: int, least: int = 24) -> tuple[list[int], int]:
    """The least doc_id of each chunk but the first, and all bytes.

    Chunks are ranges of doc_id, cut where the running bytes pass a multiple of chunk_bytes (less, to make
    `least` chunks), so a chunk is larger only by its first document. The running sum is distributed:
    ranges of ids, their sums, and a window in each range. The driver gets one number for each chunk, as it
    does for a range partitioning.
    """
    ranged = materialize(sizes.select("doc_id", "size").repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "chunk-sizes")
    sums = ranged.groupBy("part").agg(F.sum("size").alias("own"))
    total = int(sums.agg(F.coalesce(F.sum("own"), F.lit(0))).first()[0])
    step = max(1, min(chunk_bytes, -(-total // least)))
    before = sums.select("part", (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("before"))  # a row for each range
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("part").orderBy("doc_id"))
    numbered = ranged.join(F.broadcast(before), "part").select("doc_id", F.floor(F.greatest(upto - 1, F.lit(0)) / step).alias("chunk"))
    cuts = sorted(int(r["least"]) for r in numbered.groupBy("chunk").agg(F.min("doc_id").alias("least")).collect())
    return cuts[1:], total


def range_chunk(ids: Column, bounds: list[int]) -> Column:
    """Number of bounds that are <= ids, by binary search over a literal array: ranges of ids keep their order."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    arr = F.array(*[F.lit(int(b)) for b in bounds]) if len(bounds) < 64 else F.expr("array(" + ",".join(f"{int(b)}L" for b in bounds) + ")")
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda lo, step: F.when((lo + step <= len(bounds)) & (F.try_element_at(arr, lo + step) <= ids), lo + step).otherwise(lo),
    )


def with_chunks(df: DataFrame, bounds: list[int], *more: Column) -> DataFrame:
    """Columns doc_id (null: the smallest), text, more and chunk, the number of the range of doc_id."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    docs = df.select(key.alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
    return docs.withColumn("chunk", range_chunk(F.col("doc_id"), bounds).cast("int"))


def utf8(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as (bytes of all rows end to end, offsets of len + 1); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(off):
        off = np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), in place."""
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def byte_table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


BASE = 0x9E3779B97F4A7C55
INVERSE = pow(BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}
_POWERS_KEPT = 1 << 21


def powers(base: int, n: int) -> np.ndarray:
    """base ** i mod 2 ** 64 for i < n, by doubling; a table of bounded length is kept."""
    out = _POWERS.get(base)
    if out is None or len(out) < n:
        size = 1 << max(10, (n - 1).bit_length())
        out = np.ones(size, U64)
        have = 1
        while have < size:
            out[have : 2 * have] = out[:have] * U64(pow(base, have, 2**64))
            have *= 2
        if size <= _POWERS_KEPT:
            _POWERS[base] = out
    return out[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Running sums of values[i] * BASE ** i, with a leading 0; the polynomial of any run is a difference of two."""
    out = np.empty(len(values) + 1, U64)
    out[0] = 0
    np.cumsum(values * powers(BASE, len(values)), out=out[1:])
    return out


def run_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Mixed Rabin-Karp hashes of the runs [start, end)."""
    return mix((sums[end] - sums[start]) * inverse[start])


def is_gap(raw: np.ndarray) -> np.ndarray:
    return (raw == 32) | ((raw >= 9) & (raw <= 13))


def words_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and the first word of each row (len + 1)."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    word = ~is_gap(raw)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:n]
    end = word.copy()
    end[:-1] &= ~word[1:] | edge[1:n]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, off)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, U64)
    sums = prefix_hash(byte_table(seed)[raw])
    out = run_hash(sums, starts, ends, powers(INVERSE, len(raw)))
    return mix(out ^ ((ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)))


def pieces(off: np.ndarray, most: int, overlap: int) -> list[tuple[int, int, np.ndarray]]:
    """Pieces of at most about `most` bytes: (first byte, bytes whose strings count, row edges from there).

    Rows stay whole, but for a row that is longer: it is cut, and each piece sees `overlap` bytes of the next.
    """
    out, lo, n = [], 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, side="right")) - 1)
        start, end = int(off[lo]), int(off[hi])
        if end - start <= most:
            out.append((start, end - start, off[lo : hi + 1] - start))
        else:
            out.extend((at, min(most, end - at), np.array([0, min(most + overlap, end - at)])) for at in range(start, end, most))
        lo = hi
    return out


def slices(raw_off: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Row ranges of at most `most` bytes each (a longer row is a range by itself)."""
    out, lo, n = [], 0, len(raw_off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(raw_off, raw_off[lo] + most, side="right")) - 1)
        out.append((lo, min(hi, n)))
        lo = min(hi, n)
    return out
