"""Parts of large classes, and archives that are read back in one pass each."""

import collections
import random

import numpy as np

from veritrail.llm import sharding, warc


def test_classes_of_many_groups_are_numbered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 5)
    rng = random.Random(6)
    rows = [(i, f"{i:06d}") for i in range(150)] + [(200 + i, "x" * rng.randrange(1, 300)) for i in range(40)] + [(None, None), (None, "a"), (7, "b"), (7, "b")]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert len(got) == len(rows)
    slots, size = collections.defaultdict(list), collections.Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 4
    assert max(size.values()) - min(size.values()) < 0.1 * max(size.values())


def test_archives_are_opened_once(spark, monkeypatch):
    monkeypatch.setattr(warc, "OPEN", 1)
    pages = [(i, f"https://h{i % 3}.org/p{i * 7 % 40}", f"<p>{'text ' * (i % 30)}</p>") for i in range(80)]
    index = warc.merge_index(warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(6), warc.new_path(spark, "w")), range_rows=20)
    parts = index.sortWithinPartitions("run", "at").rdd.glom().map(lambda rows: [(r.run, r.at) for r in rows]).collect()
    assert all(p == sorted(p) for p in parts)
    got = {r.page_id: r.payload_bytes for r in warc.read_archives(index).collect()}
    assert got == {i: len(h) for i, _, h in pages}


def test_freed_memory_goes_back_once_a_task():
    import pyarrow as pa

    from veritrail.llm import common

    common.give_back()
    held = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096
    before = held()
    parts = [np.ones(8_000, np.int64) for _ in range(3_000)]  # small enough for the heap, not pages of their own
    keep, parts[:] = parts[-1], []
    left = held() - before
    common.give_back("one")
    assert keep.all() and held() - before < 20_000_000 + max(0, left - 190_000_000)
    assert common._LAST == ["one"]
    common.give_back("two")
    assert common._LAST == ["two"] and pa.default_memory_pool().bytes_allocated() >= 0
