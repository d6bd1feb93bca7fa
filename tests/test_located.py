from pyspark.sql import functions as F

from veritrail.operators import located, pages, validators

FIELDS = "schema string, endpoint string, timepoint string, arm string, quantity string, kind string, unit string, strategy string, rows array<string>, sections array<string>, columns array<string>"
CELLS = "doc string, page int, table int, row int, col int, header boolean, path array<string>, text string, start int, end int"


def test_specification_and_back(spark):
    rows = [("s", "a/b", "t~1", "x", "q", "count", None, "table_label", ["r"], [], ["c"]), ("s", "a/b", "t~1", "y", "q", "text", None, "text_label", ["r", "r2"], ["g"], ["c"]), ("s", "z", "t", "y", "q", "text", None, None, [], [], [])]
    spec = located.specification(spark.createDataFrame(rows, FIELDS))
    assert spec.count() == 1 and '"not_reported"' in spec.first().specification
    got = sorted((r.path, r.locate.strategy, r.locate.labels, r.locate.section_labels, r.locate.column_labels) for r in located.fields_of(spec).collect())
    assert got == [("/a~1b/t~01/x/q", "table_label", ["r"], None, ["c"]), ("/a~1b/t~01/y/q", "text_label", ["r", "r2"], ["g"], None)]
    assert located.specification(spark.createDataFrame([], FIELDS)).count() == 0


def test_groups_headers_and_proposals(spark):
    table = [["", "Drug", "Drug"], ["", "n", "HR"], ["Pain", "", ""], ["2 h", " ", ""], ["relief", "12", "0.80 (12)"], ["Other", "", ""], ["nausea", "NR", "<0.001"], ["vomiting", "x", "5"]]
    cells = [("d", 1, 1, r, c, r < 2, [], v, 100 * r + 10 * c, 100 * r + 10 * c + len(v)) for r, row in enumerate(table) for c, v in enumerate(row)]
    found = located.evidence(spark.createDataFrame(cells, CELLS))
    assert {(r.label, r.section, r.column) for r in found.where("col = 1").collect()} >= {("relief", "Pain / 2 h", "Drug n"), ("nausea", "Other", "Drug n"), ("2 h", None, "Drug n")}
    field = lambda e, q, kind, row, column, sections=(): ("d", e, "t", "a", q, kind, "u", "table_label", [row], list(sections), [column])
    fields = [field("relief", "n", "count", "relief", "Drug n", ["Pain / 2 h"]), field("relief", "hr", "ratio", "relief", "Drug HR"), field("nausea", "n", "count", "nausea", "Drug n"), field("nausea", "p", "p_value", "nausea", "Drug HR"), field("vomiting", "n", "count", "vomiting", "Drug n"), field("gone", "n", "count", "headache", "Drug n"), ("d", "none", "t", "a", "q", "text", None, None, [], [], [])]
    fields = spark.createDataFrame(fields, FIELDS)
    docs = spark.createDataFrame([("d", "d")], "doc string, schema string")
    got = {r.path: (r.status, r.value, r.start, r.end) for r in located.proposals(docs, fields, located.located(found.withColumn("schema", F.col("doc")), fields)).collect()}
    assert got["/relief/t/a/n"] == ("extracted", "12", 410, 412) and got["/nausea/t/a/n"][0] == "missing" and got["/nausea/t/a/p"][:2] == ("extracted", "<0.001")
    assert got["/relief/t/a/hr"][0] == "invalid" and got["/vomiting/t/a/n"][0] == "invalid" and got["/gone/t/a/n"][0] == "missing" and got["/none/t/a/q"][0] == "missing"


def test_estimates_and_repeated_proposals(spark):
    kind = "id string, pop string, grp string, arm string, quantity string, value string, unit string, status string, anchors int"
    row = lambda i, grp, q, v: (i, "p", grp, "pair", q, v, None, "extracted", 1)
    rows = [row("a", "g1", "smd", "-0.5"), row("b", "g1", "ci_lower", "-0.9"), row("c", "g1", "ci_upper", "-0.1"), row("d", "g2", "risk_difference", "0.3"), row("e", "g2", "ci_lower", "0.4"), row("f", "g2", "ci_upper", "0.6"), row("e2", "g2", "ci_lower", "0.1")]
    out = validators.validate(spark.createDataFrame(rows, kind), spark.createDataFrame([], "grp string, arm string, quantity string, kind string, field_unit string"), ["a"])
    got = sorted((r.id, r.passed) for r in out.where("validator = 'ci_brackets_estimate'").collect())
    assert got == [("a", True), ("b", True), ("c", True), ("d", True), ("e2", True), ("f", True)]  # e is repeated by e2
    assert out.where("validator = 'ratio_log_symmetric'").count() == 0


def test_tiles_and_offsets(spark):
    grid = spark.createDataFrame([("d", 1, 1, 2, 3, 0.0, 0.0, 90.0, 40.0), ("e", 1, 1, 1, 2, 0.0, 0.0, 10.0, 10.0)], "doc string, page int, table int, rows int, cols int, x0 double, y0 double, x1 double, y1 double")
    cells = spark.createDataFrame([("d", 1, 1, 0, 0, 1, 2, True, 1.0, 1.0, 55.0, 9.0), ("d", 1, 1, 0, 1, 1, 1, True, 30.0, 1.0, 50.0, 9.0), ("d", 1, 1, 1, 0, 5, 1, False, 2.0, 22.0, 20.0, 30.0), ("d", 1, 1, 1, 2, 1, 1, False, 70.0, 22.0, 80.0, 30.0)], "doc string, page int, table int, row int, col int, row_span int, col_span int, header boolean, x0 double, y0 double, x1 double, y1 double")
    got = {(r.row, r.col): (r.row_span, r.col_span, r.detected, r.x0, r.x1) for r in pages.tiles(grid, cells).where("doc = 'd'").collect()}
    assert got == {(0, 0): (1, 2, True, 0.0, 60.0), (0, 2): (1, 1, False, 60.0, 90.0), (1, 0): (1, 1, True, 0.0, 25.0), (1, 1): (1, 1, False, 25.0, 60.0), (1, 2): (1, 1, True, 60.0, 90.0)}
    assert [(r.col, r.x0, r.x1) for r in pages.tiles(grid, cells).where("doc = 'e'").orderBy("col").collect()] == [(0, 0.0, 5.0), (1, 5.0, 10.0)]
    words = [("d", 1, 0, None, None, 0, 0, "ﬁrst"), ("d", 1, 0, None, None, 0, 1, "line"), ("d", 1, 0, None, None, 1, 2, "end­"), ("d", 1, 2, 0, 1, 0, 0, "cell"), ("d", 1, 1, None, None, 0, 0, "​"), ("d", 3, 0, None, None, 0, 0, "last")]
    cells = [("d", 1, 2, 0, 0, 3), ("d", 1, 2, 0, 1, 3), ("d", 1, 2, 1, 1, 3)]
    streamed = pages.stream(spark.createDataFrame(words, "doc string, page int, item int, row int, col int, line int, word int, text string"), spark.createDataFrame(cells, "doc string, page int, item int, row int, col int, rows int"), spark.createDataFrame([("d", 1), ("d", 2), ("d", 3)], "doc string, page int"))
    texts = [(r.page, r.start, r.text) for r in pages.page_texts(streamed).orderBy("page").collect()]
    first = "first line\nend-\n\n\tcell\n\n"
    assert texts == [(1, 0, first), (2, len(first) + 3, ""), (3, len(first) + 6, "last")]
    whole = pages.PAGE_BREAK.join(t for _, _, t in texts)
    cut = {(r.kind, whole[r.start : r.end]) for r in pages.places(streamed).collect()}
    assert cut == {("word", w) for w in ("first", "line", "end-", "cell", "last")} | {("line", w) for w in ("first line", "end-", "cell", "last")} | {("cell", ""), ("cell", "cell"), ("table", "\tcell\n\n"), ("page", first), ("page", ""), ("page", "last")}


def test_labels_near_one_another_are_all_found(spark):
    import random

    from veritrail.functions import similarity

    rng = random.Random(3)
    words = ["mean", "total", "of", "pain", "scores", "at", "baseline", "a", "in", "hospital", "000000123", "000000124", "customer"]
    texts = {" ".join(rng.choices(words, k=rng.randrange(1, 12))) for _ in range(60)}
    for t in list(texts):
        at = rng.randrange(len(t))
        texts |= {t[:at] + rng.choice(["", "q", "zz"]) + t[at + rng.randrange(3) :], t + " x", t.replace(" ", "", 1)}
    texts = sorted(" ".join(t.split()) for t in texts if t.strip())
    labels = spark.createDataFrame([("s", t, t) for t in texts], "schema string, label string, _fl string")
    wanted = spark.createDataFrame([("s", t, t) for t in texts[::4]], "schema string, alias string, _fa string")
    for least in (0.97, 0.9):
        want = {(a, b) for a in texts[::4] for b in texts if set(a.split()) & set(b.split()) and similarity.token_set(a, b) >= 100 * least}
        got = {(r.alias, r.label) for r in located.near_labels(labels, wanted, least).collect()}
        assert want <= got
    assert len(got) < len(texts) * len(texts[::4])


def test_labels_that_are_alike_by_number_are_not_all_compared(spark, monkeypatch):
    asked, ratio = spark.sparkContext.accumulator(0), located.similarity.token_set_ratio
    tap = F.udf(lambda x: (asked.add(1), x)[1])
    monkeypatch.setattr(located.similarity, "token_set_ratio", lambda a, b: ratio(tap(a), b))
    cells = [("d", 1, 1, r, c, r < 1, [], v, 100 * r + 10 * c, 100 * r + 10 * c + 5) for r in range(121) for c, v in enumerate([f"Customer#{r:09d}" if r else "", str(r) if r else "Key"])]
    found = located.evidence(spark.createDataFrame(cells, CELLS)).withColumn("schema", F.col("doc"))
    fields = spark.createDataFrame([("d", "e", "t", f"a{r}", "q", "count", None, "table_label", [f"Customer#{r:09d}"], [], ["Key"]) for r in range(1, 61)], FIELDS)
    got = {r.path: (r.status, r.cell.text) for r in located.located(found, fields).collect()}
    assert got == {f"/e/t/a{r}/q": ("extracted", str(r)) for r in range(1, 61)}
    assert asked.value < 1000  # of 7,200 pairs
