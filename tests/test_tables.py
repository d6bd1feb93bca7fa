import json

import pytest
from pyspark.sql import functions as F

from veritrail.functions import protocol, verification
from veritrail.operators import compare, tables


def words(spark, rows, table=False):
    out = [("d", 1, 1, i, t, x, 10.0 * i, x + 8.0 * len(t), 10.0 * i + 8) for i, r in enumerate(rows) for t, x in r]
    return spark.createDataFrame(out, "doc string, page int, table int, line int, text string, x0 double, y0 double, x1 double, y1 double")


PAGE = [[("Arm", 0.0), ("A", 100.0), ("B", 160.0)], [("Deaths", 0.0), ("3", 100.0), ("4", 160.0)], [("Events", 0.0), ("5", 100.0), ("6", 160.0)], [("Lost", 0.0), ("7", 100.0), ("8", 160.0)], [("a", 0.0), ("note", 20.0)]]


def test_word_tables(spark):
    got = {(r.row, r.col): r.text for r in tables.word_tables(words(spark, PAGE)).collect()}
    assert got[(0, 1)] == "A" and got[(1, 0)] == "Deaths" and got[(3, 2)] == "8" and max(r for r, _ in got) == 3
    grid = {(r.row, r.col): r.text for r in tables.word_grids(words(spark, PAGE[:4])).collect()}
    assert grid[(2, 0)] == "Events" and grid[(2, 2)] == "6"


def test_headers_and_torn(spark):
    t = spark.createDataFrame([("d", 1, 1, 2, ["x", "y"], False, True), ("d", 2, 1, 2, None, True, True), ("d", 3, 1, 3, None, True, True)], "doc string, page int, table int, columns int, header array<string>, first boolean, last boolean")
    assert [(r.carried, r.header) for r in tables.carried_headers(t).orderBy("page").collect()] == [(False, ["x", "y"]), (True, ["x", "y"]), (False, None)]
    c = spark.createDataFrame([("d", 1, 1, 0, 0, "Deaths"), ("d", 1, 1, 0, 1, "3"), ("d", 1, 1, 1, 0, "Eve"), ("d", 1, 1, 1, 1, "5")], "doc string, page int, table int, row int, col int, text string")
    assert tables.torn_tables(c, words(spark, PAGE)).first()["torn"]
    h = spark.createDataFrame([("d", 1, 1, 0, 0, ""), ("d", 1, 1, 0, 1, "Drug"), ("d", 1, 1, 0, 2, ""), ("d", 1, 1, 1, 1, "n"), ("d", 1, 1, 1, 2, "%"), ("d", 1, 1, 2, 2, "5")], c.schema)
    assert [r.header for r in tables.header_paths(h, 2).collect()] == ["Drug / %"]
    f = spark.createDataFrame([("d", 1, i * 2 + j, t, x, x + 20.0, 10.0 * i, 10.0 * i + 8) for i, (a, b) in enumerate([("Age", "64"), ("Sex", "f"), ("Dose", "5")]) for j, (t, x) in enumerate([(a, 0.0), (b, 50.0)])], "doc string, page int, line int, text string, x0 double, x1 double, y0 double, y1 double")
    assert [(r.row, r.text) for r in tables.form_tables(f).where("col = 1").orderBy("row").collect()] == [(0, "64"), (1, "f"), (2, "5")]


def test_protocol(spark):
    p = {"topics": [{"id": "t"}], "criteria": [{"id": "c1", "topic": "t", "text": "adults"}, {"id": "c1", "topic": "u", "text": ""}], "sources": [{"id": "s", "strategy": "(a"}], "mode": "single_with_ai", "stopping": {"target_recall": 2}}
    assert {x for x, _ in protocol.problems(p)} == {"/criteria/1", "/criteria/1/topic", "/sources/0/strategy", "/audit", "/stopping/target_recall"}
    assert protocol.criteria(spark, p).count() == 4
    with pytest.raises(ValueError):
        protocol.unique_keys('{"a":1,"a":2}')
    q = json.loads(json.dumps(p))
    q["criteria"][0]["text"] = "children"
    one = {**p, "criteria": p["criteria"][:1]}
    two = {**q, "criteria": q["criteria"][:1]}
    assert [(r.path, r.kind) for r in compare.diff_paths(protocol.flat(spark, one), protocol.flat(spark, two)).collect()] == [("/criteria/c1/text", "changed")]
    assert [r.problem for r in protocol.sentinels(spark, '[{"doi":"10.1/x"},{"outcome":"include"}]').collect()] == [None, "no identifier"]


def test_verification(spark):
    t = "We studied mice. Adults were not included here."
    rows = [("Adults were not included", ["adult"], "stated", None), ("adults excluded", ["adult"], "stated", "found"), ("mice. Adults", ["adult"], "stated", "one_sentence"), ("We studied mice", ["adult"], "stated", "key_term"), ("Adults were", ["adult"], "negated", "negation"), ("were not included", ["included"], "negated", None), ("", ["children"], "absent", None), ("", ["mouse", "adults"], "absent", "whole_reading")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, q string, k array<string>, b string, want string")
    got = [r[0] for r in df.orderBy("i").select(verification.verification("q", F.lit(t), "k", "b")).collect()]
    assert got == [r[3] for r in rows]
    assert verification.criterion_terms(["RCT"], "Randomised trials of the drug", {"trials"}) == ["RCT", "Randomised"]
