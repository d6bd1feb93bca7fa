"""The page model: a document's words are dealt with its text, and what is read of a stream at once is what places and page_texts give."""

import random

import __spark_entry__ as entry
from pyspark.sql import functions as F

from veritrail.operators import pages


def test_words_are_not_shuffled(spark, sf):
    for name in ("doc_assembled", "doc_places"):
        plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        dealt = [line for line in plan.splitlines() if "Exchange" in line]
        assert dealt and all("REPARTITION_BY_NUM" in line for line in dealt), name


def test_whole_texts_have_all_places(spark):
    rng = random.Random(2)
    words, cells, leaves = [], [], set()
    for doc in "ab":
        for page in (0, 1, 3, 4):
            leaves.add((doc, page))
            for item in range(rng.randrange(4)):
                if rng.random() < 0.5:
                    words += [(doc, page, item, None, None, line, i, rng.choice(["x", "yy", "", "é"])) for line in range(3) for i in range(rng.randrange(4))]
                    continue
                rows = rng.randrange(1, 4)
                for row in range(rows - rng.randrange(2)):
                    for col in range(3):
                        cells.append((doc, page, item, row, col, rows))
                        words += [(doc, page, item, row, col, line, i, rng.choice(["c", "dd"])) for line in range(2) for i in range(rng.randrange(3))]
    frames = [spark.createDataFrame(sorted(set(rows), key=str), kinds) for rows, kinds in ((words, "doc string, page int, item int, row int, col int, line int, word int, text string"), (cells, "doc string, page int, item int, row int, col int, rows int"), (leaves, "doc string, page int"))]
    streamed = pages.stream(*frames)
    texts = {}
    for r in pages.page_texts(streamed).orderBy("doc", "page").collect():
        before = texts.get(r.doc)
        assert r.start == (0 if before is None else len(before) + len(pages.PAGE_BREAK))
        texts[r.doc] = r.text if before is None else before + pages.PAGE_BREAK + r.text
    got = {r.doc: r for r in pages.whole_texts(streamed).collect()}
    assert {d: r.whole for d, r in got.items()} == texts and "é" in "".join(texts.values())
    for kind in ("word", "line", "cell"):
        want = sorted(tuple(r) for r in pages.places(streamed).where(F.col("kind") == kind).select("doc", "start", "end").collect())
        assert sorted((d, s, e) for d, r in got.items() for s, e in zip(r[kind].starts, r[kind].ends)) == want and want
