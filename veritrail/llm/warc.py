"""WARC archives of pages, and an external merge of their index.

Write tasks sort their captures by URL key and timestamp, write one gzip-per-record archive
each and leave a run of index rows in that order. Merge tasks own ranges of (URL key,
timestamp): each merges its part of all runs through a loser tree, so the parts one after
another are one globally ordered capture history, which is written. Archives are read back in
its order: in a range of keys, the records of a run lie one behind the other. The digest of
every payload read is computed anew; one that differs from its record's ends the job.

Of records with equal payloads of at least `least_bytes` bytes, the one with the smallest
page_id is a response and the others revisit it.

Defined cases: a null html is an empty payload; a null page_id never becomes the smallest (a
group of null ids only has no response and keeps each as one); rows that repeat the smallest
page_id are all responses; a null or empty url has an empty target and sorts first; an empty
table gives an empty result and no archive. A task that is run again writes a new archive
under a new name, and the index names only archives of tasks that ended.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import materialize, new_path, table

INDEX = "url_key string, ts long, page_id long, run string, at long, length long"
INDEX_ARROW = pa.schema([("url_key", pa.string()), ("ts", pa.int64()), ("page_id", pa.int64()), ("run", pa.string()), ("at", pa.int64()), ("length", pa.int64())])
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, ts long, payload binary"
READ_ARROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("ts", pa.int64()), ("payload", pa.binary())])
#: Archives that a reading task keeps open.
OPEN = 64
BREAKS = re.compile(r"[\r\n]+")


def url_key(url: Column) -> Column:
    """Host labels from the right, comma-separated, then ')' and the path: neighbours share sites."""
    url = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rest = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^#]*)", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.lower(rest))


def record_types(pages: DataFrame, least_bytes: int) -> DataFrame:
    """pages with payload_bytes, payload_digest and refers_to (null for responses)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    own = own.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    same = own.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    same = materialize(same.where("n > 1").select(F.col("payload_digest").alias("of"), "first"), "warc-same")
    lone = F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))  # short payloads meet nobody, and not in one task
    keyed = own.withColumn("of", F.when(F.col("payload_bytes") >= least_bytes, F.col("payload_digest")).otherwise(lone))
    other = (F.col("first") != F.col("page_id")) | (F.col("page_id").isNull() & F.col("first").isNotNull())
    return keyed.join(same, "of", "left").withColumn("refers_to", F.when(other, F.col("first"))).drop("of", "first")


def stamp(ts: int) -> str:
    return datetime.fromtimestamp(ts, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id, url: str | None, ts: int, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header (with the full length) and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    body = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        f"WARC-Date: {stamp(ts)}",
        f"WARC-Target-URI: {BREAKS.sub(' ', url or '')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of one record as written."""
    head, _, body = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    body = body[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = next(int(x[16:]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is damaged")
    return {
        "page_id": int(fields["X-Page-ID"]) if fields["X-Page-ID"] else None,
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": int(fields["X-Refers-To-Page-ID"]) if "X-Refers-To-Page-ID" in fields else None,
        "url": fields["WARC-Target-URI"] or None,
        "ts": int(datetime.strptime(fields["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc).timestamp()),
        "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, place, run_id = None, 0, f"{folder}/{uuid.uuid4().hex}.warc.gz"
        try:
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    if out is None:
                        where, path = fs.FileSystem.from_uri(run_id)
                        where.create_dir(path.rpartition("/")[0], recursive=True)
                        out = where.open_output_stream(path, compression=None)
                    raw = gzip.compress(record(r["page_id"], r["url"], r["ts"], r["payload"], r["payload_digest"], r["refers_to"]), 3, mtime=0)
                    out.write(raw)
                    rows.append({"url_key": r["url_key"], "ts": r["ts"], "page_id": r["page_id"], "run": run_id, "at": place, "length": len(raw)})
                    place += len(raw)
                yield pa.RecordBatch.from_pylist(rows, INDEX_ARROW)
        finally:
            if out is not None:
                out.close()

    return run


class LoserTree:
    """Merge sorted iterators: the losers of all matches stay in the tree, the winner is on top."""

    def __init__(self, runs: list[Iterator], key):
        self.runs, self.key, k = runs, key, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.tree = [-1] * k  # tree[0]: the winner; the others: the loser of the match there
        for i in range(k):
            self._play(i, first=True)

    def _before(self, i: int, j: int) -> bool:
        a, b = self.heads[i], self.heads[j]
        if a is None or b is None:
            return b is None and a is not None
        return (self.key(a), i) < (self.key(b), j)

    def _play(self, i: int, first: bool = False) -> None:
        k, node = len(self.runs), (i + len(self.runs)) // 2
        while node > 0:
            if self.tree[node] < 0 and first:
                self.tree[node] = i  # waits for its opponent
                return
            if self._before(self.tree[node], i):
                self.tree[node], i = i, self.tree[node]
            node //= 2
        self.tree[0] = i
        assert k

    def __iter__(self):
        while self.runs and self.heads[w := self.tree[0]] is not None:
            yield self.heads[w]
            self.heads[w] = next(self.runs[w], None)
            self._play(w)


def order(r: dict) -> tuple:
    return r["url_key"], r["ts"], r["page_id"] is not None, r["page_id"] or 0


def merger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range of keys come run after run, each in order; they leave in one order. Memory: the index rows of the range."""
    runs: dict[str, list[dict]] = {}
    for batch in batches:
        for r in batch.to_pylist():
            runs.setdefault(r["run"], []).append(r)
    rows = []
    for r in LoserTree([iter(x) for _, x in sorted(runs.items())], order):
        rows.append(r)
        if len(rows) == 10_000:
            yield pa.RecordBatch.from_pylist(rows, INDEX_ARROW)
            rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, INDEX_ARROW)


def reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    files: dict[str, object] = {}  # the archives read last stay open
    try:
        for batch in batches:
            rows, held = [], 0
            for r in batch.to_pylist():
                file = files.pop(r["run"], None)
                if file is None:
                    where, path = fs.FileSystem.from_uri(r["run"])
                    file = where.open_input_file(path)
                    if len(files) >= OPEN:
                        files.pop(next(iter(files))).close()
                files[r["run"]] = file
                file.seek(r["at"])
                rows.append(parse(zlib.decompress(file.read(r["length"]), 31)))
                held += rows[-1]["payload_bytes"]
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, READ_ARROW)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, READ_ARROW)
    finally:
        for file in files.values():
            file.close()


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 100, first_ts: int = 1_700_000_000) -> DataFrame:
    """Write pages (page_id, url, html) as archives in folder; the index rows, run by run.

    Pages carry no time of capture: page_id seconds (within a year) after first_ts stand for it.
    """
    ts = F.lit(first_ts) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(365 * 86_400))
    typed = record_types(pages, least_bytes).withColumns({"url_key": url_key(F.col("url")), "ts": ts.cast("long")})
    columns = ["page_id", "url", "ts", "payload", "payload_digest", "refers_to", "url_key"]
    runs = typed.select(*columns).sortWithinPartitions("url_key", "ts", F.col("page_id").asc_nulls_first())
    return materialize(runs.mapInArrow(writer(folder), INDEX), "warc-runs")


def merge_index(runs: DataFrame, range_rows: int = 50_000) -> DataFrame:
    """All runs' index rows in the order of (url_key, ts, page_id), over range partitions of about range_rows rows, written."""
    keys = ["url_key", "ts", F.col("page_id").asc_nulls_first()]
    n = max(1, -(-runs.count() // range_rows))
    return materialize(runs.repartitionByRange(n, *keys).sortWithinPartitions("run", *keys).mapInArrow(merger, INDEX), "warc-index")


def read_archives(index: DataFrame) -> DataFrame:
    """The records that the index names, read from their archives. A task reads its range of the index archive by archive, each from front to back, so it opens each once."""
    return index.sortWithinPartitions("run", "at").mapInArrow(reader, READ)


def op9_warc(spark, sf_dir: str) -> DataFrame:
    runs = write_archives(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return read_archives(merge_index(runs)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
