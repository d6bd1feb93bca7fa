import pytest

from pyspark.sql import functions as F

from veritrail.functions import canonical
from veritrail.functions.specification import compile_plan
from veritrail.operators import compare, identity, ranking, review_table, validators
from veritrail.sources import records


def test_compile_plan(spark):
    spec = '{"sections": [{"key": "s", "fields": [{"key": "a", "pointer": "/x/0", "operator": "numeric", "tolerance": {"absolute": 0.5}}, {"key": "b", "pointer": "/y~1z"}, {"key": "c", "pointer": "/no", "required": false}]}]}'
    plan, bad = compile_plan(spark, spec, '{"x": [1.5], "y/z": "t"}')
    assert [(r.key, r.expected, r.operator, r.absolute) for r in plan.orderBy("key").collect()] == [("a", "1.5", "numeric", 0.5), ("b", "t", "exact", None)] and bad.count() == 0
    found = spark.createDataFrame([(r.field, "1.9", "extracted") for r in plan.where("key = 'a'").collect()], "field string, actual string, status string")
    got = compare.compare_fields(plan.select("field", "expected", "operator", "absolute", "relative", "severity"), found)
    assert {r.match_status for r in got.where("actual is not null").collect()} == {"match"}
    again, _ = compile_plan(spark, spec.replace(" ", ""), '{"x": [2], "y/z": "u"}')
    assert {r.field for r in again.collect()} == {r.field for r in plan.collect()}


@pytest.mark.parametrize("spec, path", [("{", "/"), ("{}", "/sections"), ('{"sections": [{"key": "s", "fields": [{"key": "a", "pointer": "/q"}]}]}', "/sections/0/fields/0/pointer"), ('{"sections": [{"key": "s", "fields": [{"key": "a", "pointer": "/x", "operator": "like"}]}]}', "/sections/0/fields/0/operator")])
def test_bad_specifications(spark, spec, path):
    plan, bad = compile_plan(spark, spec, '{"x": 1}')
    assert plan.count() == 0 and [r.path for r in bad.collect()] == [path]


def test_formats_have_names():
    assert records.parser_of("Embase") is records.parse_ris and records.parser_of("MEDLINE") is records.parse_nbib and records.parser_of("records-csv") is records.parse_list
    with pytest.raises(ValueError, match="unknown format"):
        records.parser_of("pdf")


def test_unreadable_json_has_no_leaves(spark):
    df = spark.createDataFrame([('{"a": [1, {}]}',), ("{",), (None,)], "t string")
    assert [r[0] and [tuple(x) for x in r[0]] for r in df.select(canonical.json_leaves("t")).collect()] == [[("/a/0", "1"), ("/a/1", "{}")], None, []]


def test_revision_chain(spark):
    df = spark.createDataFrame([("d", "c"), ("c", "b"), ("b", None), ("x", "b"), ("p", "q"), ("q", "p")], "revision_id string, parent_id string")
    assert sorted(map(tuple, identity.chain(df, "d").collect())) == [("b", 2), ("c", 1), ("d", 0)]
    assert identity.chain(df, "none").count() == 0
    with pytest.raises(ValueError, match="cycle"):
        identity.chain(df, "p")


def test_stack_of_undos(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "undo"), (1, 4, "undo"), (1, 5, "undo"), (2, 1, "a"), (2, 2, "undo"), (2, 3, "c"), (3, 9, "undo")], "k int, seq int, kind string")
    assert [tuple(r) for r in ranking.replay_stack(df, ["k"], "seq", "kind", "undo").collect()] == [(2, "c", 3)]
    assert sorted(tuple(r) for r in ranking.replay_stack(df, ["k"], "seq", "kind", "undo", 2).collect()) == [(1, "b", 2)]


def test_denominators_and_empty(spark):
    kind = "id string, pop string, grp string, arm string, quantity string, value string, unit string, status string, anchors int"
    rows = [("n1", "p", "g1", "a", "n_randomized", "50", None, "extracted", 1), ("e1", "p", "g1", "a", "events", "51", None, "extracted", 1), ("e2", "p", "g2", "a", "events", "50", None, "extracted", 1), ("e3", "q", "g3", "a", "events", "1", None, "extracted", 1), ("m", "p", "g2", "b", "events", None, None, "missing", 0)]
    fields = spark.createDataFrame([], "grp string, arm string, quantity string, kind string, field_unit string")
    out = validators.validate(spark.createDataFrame(rows, kind), fields, ["a"])
    assert sorted((r.id, r.passed) for r in out.where("validator = 'events_at_most_n'").collect()) == [("e1", False), ("e2", True), ("n1", False), ("n1", True)]
    assert validators.validate(spark.createDataFrame([], kind), fields, ["a"]).count() == 0


def test_decisions_are_refused_out_of_turn(spark):
    e = spark.createDataFrame([(1, 1, "final", "include", None), (1, 2, "provisional", "exclude", "c1"), (1, 3, "provisional", "include", None), (1, 4, "final", "include", None), (1, 5, "final", "exclude", "c2")], "assignment int, seq int, phase string, outcome string, criterion string")
    got = review_table.decided(e, F.col("outcome") == "exclude").first()
    assert (got.state, got.outcome, got.provisional, got.refused) == ("decided", "include", "exclude", [1, 3, 5])
