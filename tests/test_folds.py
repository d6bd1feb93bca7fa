"""Folds of many small groups, and steps whose time must not grow with the square of the input."""

import random
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrail.functions import similarity, spans, statistics
from veritrail.operators import anchors, extraction, folds, identity, ranking, tables, validators
from veritrail.sources import records


def test_folds_go_over_batches_and_null_keys(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = spark.range(1000).select(F.when(F.col("id") % 10 > 0, F.col("id") % 10).alias("k"), (-F.col("id")).alias("v"))
        got = folds.folded(rows, ["k"], ["v"], lambda g: [(g[0][0], len(g), [v for _, v in g])], "k long, n int, vs array<long>").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.k: r.n for r in got} == {k or None: 100 for k in range(10)}
    assert all(r.vs == sorted(r.vs) for r in got)


def test_quotes_make_no_patterns_for_plain_texts(monkeypatch):
    monkeypatch.setattr(spans, "_pattern", None)
    assert spans.find_quote("b c", "a b\n c b c") == [(2, 6), (7, 10)]
    assert spans.find_quote("aa", "aaa") == [(0, 2), (1, 3)]
    assert spans.find_quote("abc", "x-y") == [] and spans.find_quote(" ", "a b") == []


def test_partial_ratio_compares_all_stretches_at_once():
    long = "words that say nothing of interest at all " * 500
    for short in ("0123456789 abcdef", "nothing of xx interest " * 4):
        n = len(short)
        want = max((similarity.ratio(short, long[s : s + n]), -s) for s in range(60))
        begun = time.process_time()
        assert similarity.partial(short, long) == (want[0], -want[1], n - want[1])
        assert time.process_time() - begun < 0.15


def test_anchors_and_page_checks_are_dealt_to_all_partitions(spark):
    one = spark.range(64).coalesce(1)
    quotes = one.select(F.col("id").cast("string").alias("anchor_id"), F.lit("d").alias("doc"), F.lit("q").alias("quote"), F.lit("").alias("prefix"), F.lit("").alias("suffix"), F.lit(0).alias("start"))
    layers = spark.createDataFrame([("d", "l", "a q")], "doc string, layer string, text string")
    found = anchors.resolve(quotes, layers)
    assert {r.start for r in found.collect()} == {2}
    assert found.rdd.getNumPartitions() > 1


def test_long_histories_of_sets_fold_in_linear_steps(spark):
    n = 60_000
    k = F.col("id").cast("int")
    links = spark.range(n).select(F.lit(1).alias("project_id"), k.alias("seq"), F.lit("merge").alias("kind"), F.array(k, k + F.when(k % 2 == 0, 1).otherwise(-1)).alias("occurrence_ids"), F.lit("x").alias("said"))
    begun = time.monotonic()
    assert identity.why(links).select(F.size("occurrence_ids").alias("n"), F.size("why").alias("w")).distinct().collect() == [(2, 2)]
    assert time.monotonic() - begun < 60


def test_sets_are_those_of_the_plain_fold(spark):
    def plain(events):
        held = []
        for kind, ids, said in events:
            ids = set(ids)
            if kind == "merge":
                met = [h for h in held if h[0] & ids]
                held = [h for h in held if not h[0] & ids]
                held.append((ids.union(*(h[0] for h in met)), [x for h in met for x in h[1]] + [said]))
            else:
                held = [h for h in ((s - ids, w) for s, w in held) if len(h[0]) > 1]
        return sorted((sorted(s), w) for s, w in held)

    draw = random.Random(5)
    histories = {p: [(draw.choice(["merge"] * 3 + ["split"]), [draw.randrange(14) for _ in range(draw.choice([1, 2, 2, 3]))], f"{p}.{i}") for i in range(draw.randrange(1, 25))] for p in range(150)}
    rows = [(p, i, *e) for p, h in histories.items() for i, e in enumerate(h)]
    got: dict = {}
    for r in identity.why(spark.createDataFrame(rows, "project_id int, seq int, kind string, occurrence_ids array<int>, said string")).collect():
        got.setdefault(r.project_id, []).append((list(r.occurrence_ids), list(r.why)))
    assert {p: sorted(got.get(p, [])) for p in histories} == {p: plain(h) for p, h in histories.items()}


def test_files_are_read_some_records_at_a_time(monkeypatch):
    assert list(records.lines_of("a\r\nb\x0bc\n\n" * 20_000)) == ("a\r\nb\x0bc\n\n" * 20_000).splitlines()
    bodies = {
        "ris": "TY  - JOUR\nTI  - a\nER  - \n" * 40_000 + "TY  - JOUR\n",
        "nbib": "PMID- 1\nTI  - a\n" * 40_000 + "PMID- x\n",
        "scopus": "EID,Title\n" + "1,a\n" * 40_000 + "1\n",
        "list": "Title,PMID\n" + "a,1\n" * 40_000 + "a,x\n",
        "registry": "id,title\n" + "1,a\n" * 40_000 + "1\n",
    }
    for format, body in bodies.items():
        tracemalloc.start()
        rows = records.parser_of(format)(body, format)
        assert next(rows)["title"] == "a"
        held = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert held < 8 * len(body), format
        with pytest.raises(ValueError):
            list(rows)


def test_a_list_without_records_beside_others_is_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Title,EID\n")
    (tmp_path / "b.csv").write_text("Title,EID\nT,1\n")
    for format in ("scopus", "list"):
        assert [r.title for r in records.read_records(spark, str(tmp_path), format).collect()] == ["T"]


def test_the_conformal_place_is_searched():
    begun = time.monotonic()
    place = statistics.conformal_order(60_000, 0.9, 0.05)
    assert time.monotonic() - begun < 10
    assert statistics.binomial_cdf(place - 1, 60_000, 0.1) <= 0.05 < statistics.binomial_cdf(place, 60_000, 0.1)


def test_a_group_of_the_pool_is_ranked_by_slices(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), F.col("id").alias("r"))
    order = Window.partitionBy("g").orderBy(ranking.seeded_key("s", F.col("r")), "r")
    want = rows.withColumn("reader", F.get(F.array(F.lit("a"), F.lit("b")), (F.row_number().over(order) - 1) % 2))
    got = ranking.split_pool(rows, ["g"], "r", ["a", "b"], "s")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert "_slice" in got._jdf.queryExecution().executedPlan().toString()


def test_exploded_sides_are_never_broadcast(spark):
    base = spark.range(50).select(F.col("id").cast("string").alias("doc"), F.lit(1).alias("page"))
    line = lambda n, text, x: F.struct(F.lit(n).alias("line"), F.lit(text).alias("text"), F.lit(float(x)).alias("x0"), F.lit(0.0).alias("y0"), F.lit(float(x + 10)).alias("x1"), F.lit(10.0).alias("y1"))
    lines = base.withColumn("l", F.explode(F.array(line(1, "Size:", 0), line(2, "7", 20)))).select("doc", "page", "l.*")
    for df in (extraction.beside_candidates(lines, 600.0), extraction.prose(lines, "Size", "End")):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    parts = base.select(F.col("doc").alias("grp"), F.lit("all").alias("pop"), F.lit("a").alias("arm"), F.lit("events").alias("quantity"), F.lit("1").alias("value"), F.lit(None).cast("string").alias("unit"), F.lit("extracted").alias("status"), F.lit(1).alias("anchors"), F.col("doc").alias("id"))
    fields = parts.select("grp", "arm", "quantity", F.lit("count").alias("kind"), F.lit(None).cast("string").alias("field_unit"))
    assert "Broadcast" not in validators.validate(parts, fields, ["a"])._jdf.queryExecution().executedPlan().toString()


def test_many_cuts_of_a_text_are_made_in_one_go(spark):
    own = spark.sql("SELECT 'a\U0001F600bc' AS t, array(0L, 1L, 2L) AS s, array(1L, 2L, 4L) AS e UNION ALL SELECT NULL, array(0L), array(1L)")
    assert [r.c for r in own.select(spans.cut_out("t", "s", "e").alias("c")).collect()] == [["a", "\U0001F600", "bc"], None]


def test_rows_of_a_fold_are_sent_some_at_a_time(spark):
    sent = spark.range(1).select(F.lit(1).alias("k"), "id")
    sizes = folds.folded(sent, ["k"], ["id"], lambda g: ((i,) for i in range(3 * folds.SENT)), "v int")
    assert sizes.count() == 3 * folds.SENT


def test_tables_of_pages_are_not_frames(spark):
    words = spark.createDataFrame([("d", 1, 1, n, t, x, x + 10.0) for n in range(4) for t, x in ((f"r{n}", 0.0), (str(n), 50.0))], "doc string, page int, table int, line int, text string, x0 double, x1 double")
    for made in (tables.word_grids(words), tables.word_tables(words.drop("table"))):
        assert sorted((r.row, r.col, r.text) for r in made.collect()) == sorted(x for n in range(4) for x in ((n, 0, f"r{n}"), (n, 1, str(n))))
        assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().executedPlan().toString()
