import json
import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from veritrail.operators import extraction, stages
from veritrail.sources import sinks


def test_opening(spark):
    items = spark.createDataFrame([(f"i{k}",) for k in range(10)], "item string")
    known = spark.createDataFrame([("s",)], "item string")
    a = stages.opened(items, ["ann", "bob", "eve"], "seed", True, 25.0, known)
    rows = a.collect()
    count = {r: sum(x.role == r for x in rows) for r in ("first", "second", "audit", "sentinel")}
    assert count == {"first": 10, "second": 10, "audit": 3, "sentinel": 3} and len({x.assignment_id for x in rows}) == len(rows)
    by = {}
    for x in rows:
        if x.role != "sentinel":
            by.setdefault(x.item, []).append(x.reader)
    assert all(len(set(v)) == len(v) for v in by.values())
    assert sorted(rows) == sorted(stages.opened(items, ["ann", "bob", "eve"], "seed", True, 25.0, known).collect())


def test_effects(spark):
    e = spark.createDataFrame([(1, 1, "decide", "include"), (1, 2, "decide", "exclude"), (1, 3, "undo", None), (2, 1, "decide", "include"), (2, 2, "withdraw", None), (3, 1, "decide", "include"), (3, 2, "adjudicate", "exclude")], "assignment int, seq int, kind string, outcome string")
    assert {r.assignment: r.outcome for r in stages.effective(e).collect()} == {1: "include", 2: None, 3: "exclude"}
    k = spark.createDataFrame([(["a"], ["b"], ["b", "c"])], "o array<string>, s array<string>, k array<string>")
    assert k.select(stages.after_decision(F.col("o"), F.col("s"), F.col("k"))).first()[0] == ["a", "c"]
    rows = spark.createDataFrame([("x",), ("y",), ("z",)], "item string")
    own = spark.createDataFrame([("x", "ann", "1", False), ("y", "ann", "2", True)], "item string, reader string, assignment_id string, decided boolean")
    assert {r.item: r.refused for r in stages.bulk(rows, own, "ann", "include", None, "b").collect()} == {"x": None, "y": "already_decided", "z": "not_assigned"}
    acc = spark.createDataFrame([("k1", "g", "agreed", False, None, True, True), ("k2", "g", "conflict", False, None, False, True), ("k3", None, "agreed", True, "why", True, False)], "key string, group_id string, state string, edited boolean, note string, both_agree boolean, gated boolean")
    assert {r.key: r.accepted for r in stages.acceptance_problems(acc.fillna("alone", ["group_id"])).collect()} == {"k1": False, "k2": False, "k3": True}


def test_results(spark):
    s = "doc string, field string, status string, value string, score double, runner_up string"
    a = spark.createDataFrame([("d", "x", "extracted", "1", 0.9, None), ("d", "y", "missing", None, None, None)], s)
    b = spark.createDataFrame([("d", "x", "extracted", "9", 0.8, None), ("d", "y", "extracted", "2", 0.8, None)], s)
    out = extraction.with_inferred(a, b)
    assert {r.field: (r.value, r.inferred) for r in out.collect()} == {"x": ("1", False), "y": ("2", True)}
    assert json.loads(extraction.nested(out, {"x": "base/x", "y": "y"}).first()["output"]) == {"base": {"x": "1"}, "y": "2"}
    svg = sinks.flow_svg(spark.createDataFrame([("identified", 5)], "metric string, n long"), "a < b")
    assert "n = 5" in "".join(ET.fromstring(svg).itertext())
