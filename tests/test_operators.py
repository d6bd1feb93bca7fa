import itertools
import random

from pyspark.sql import functions as F

from veritrail.functions import similarity
from veritrail.operators import agreement, appraisal, compare, extraction, graph, grid, layout, ledger, linkage, ranking, screening
from veritrail.plans import catalog, catalog_more


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns[:1])).collect()]


def test_agreement(spark):
    one = spark.createDataFrame([("a", "a"), ("a", "a"), (None, "b")], "x string, y string")
    assert rows(agreement.cohen(one, "x", "y")) == [(2, 1.0, None, 1.0)]
    r = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "a")], "i int, l string")
    assert agreement.fleiss(r, "i", "l").first()["kappa"] is None
    assert agreement.confusion(spark.createDataFrame([], "r boolean, e boolean"), F.col("r"), F.col("e")).first()["recall"] is None
    best = agreement.best_record(spark.createDataFrame([(1, 1, "ab", None, ["x"]), (1, 2, "cd", "d", ["y", "x"]), (1, 3, "e", "f", None)], "r int, o int, t string, f string, u array<string>"), "r", ["o"], "t", ["f"], ["u"])
    assert rows(best) == [(1, "ab", "d", ["x", "y"])]


def test_ranking(spark):
    e = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "undo"), (2, 1, "undo"), (2, 4, "c")], "k int, seq int, t string")
    assert rows(ranking.replay(e, ["k"], "seq", "t", "undo")) == [(2, "c", 4)]
    assert rows(ranking.replay_stack(e, ["k"], "seq", "t", "undo")) == [(1, "a", 1), (2, "c", 4)]
    assert rows(ranking.replay_stack(e, ["k"], "seq", "t", "undo", 2)) == [(1, "b", 2)]
    m = spark.createDataFrame([(1, 0, 5), (1, 30, 40), (1, 140, 150)], "d int, s int, e int")
    assert [r.passage for r in ranking.islands(m, ["d"], "s", "e", 60).orderBy("s").collect()] == [1, 1, 2]
    c = ranking.carried(spark.createDataFrame([(1, 1, "h"), (1, 2, None), (1, 3, "i")], "g int, o int, v string"), ["g"], "o", "v", "w")
    assert [r.w for r in c.orderBy("o").collect()] == ["h", "h", "i"]
    assert spark.range(1).select(ranking.share_of(F.lit("2.5"), F.lit(41))).first()[0] == 2


def test_ledger(spark):
    e = spark.createDataFrame([(1, i, f"e{i}", "t", "a", "now", f"{{{i}}}") for i in range(1, 6)], "project_id int, seq int, event_id string, type string, actor_id string, recorded_at string, payload string")
    sealed = ledger.chained(e)
    assert ledger.verify(sealed).first()["problem"] is None
    assert ledger.verify(sealed.where("seq <> 3")).first()["problem"] == "gap"
    marks = sealed.where("seq = 5").select("project_id", "seq", "event_hash")
    assert ledger.verify(sealed.where("seq < 5"), marks).first()["problem"] == "tail_cut"
    bad = sealed.withColumn("event_hash", F.when(F.col("seq") == 2, "x").otherwise(F.col("event_hash")))
    assert {(r.seq, r.problem) for r in ledger.audit(bad).collect()} == {(2, "hash"), (3, "link")}


def test_components(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "a string, b string")
    assert dict(rows(graph.connected(e))) == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_alike_titles(spark):
    rng = random.Random(5)
    titles = set()
    for _ in range(20):
        b = " ".join(sorted("".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 8))) for _ in range(rng.randrange(1, 10))))
        for _ in range(5):
            t = list(b)
            for _ in range(rng.randrange(4)):
                t.insert(rng.randrange(len(t) + 1), rng.choice("abc "))
            titles.add("".join(t).strip())
    got = {tuple(sorted((r.a, r.b))) for r in linkage.alike_titles(spark.createDataFrame([(t,) for t in titles], "title string")).collect()}
    assert got == {tuple(sorted(p)) for p in itertools.combinations(sorted(titles), 2) if similarity.ratio(*p) >= 90}


def test_linkage(spark):
    r = [
        (1, "A trial of aspirin in adults", ["Smith J"], 2020, "10.1/a", None, None, ["NCT00000001"]),
        (2, "A trial of aspirin in adult", ["Smith J"], 2021, None, "5", None, []),
        (3, "Other words entirely here", ["Doe A"], 2020, "https://doi.org/10.1/A", None, None, []),
        (4, "A trial of aspirin in adults", ["Smith J"], 2020, "10.1/b", None, None, ["NCT00000001"]),
        (5, "Phase 2 trial of aspirin in adults", ["Roe B"], 1999, None, None, None, []),
    ]
    df = spark.createDataFrame([(i, i, t, a, y, d, p, m, g) for i, t, a, y, d, p, m, g in r], "occurrence_id int, input_pos int, title string, authors array<string>, year int, doi string, pmid string, pmcid string, registry_ids array<string>")
    pairs = linkage.link_pairs(df)
    assert {(x.a, x.b) for x in pairs.collect()} == {(1, 2), (1, 3), (2, 4)}
    grouped = linkage.groups(df, pairs)
    got = dict(rows(grouped))
    assert got[1] == got[2] == got[3] == 1 and got[4] == 4 and got[5] == 5
    props = linkage.proposals(grouped, pairs).collect()
    assert len(props) == 1 and props[0].occurrence_ids == [1, 2, 3] and not props[0].exact
    assert [(p.occurrence_ids, p.registry_ids) for p in linkage.study_proposals(df, grouped).collect()] == [([1, 4], ["NCT00000001"])]
    links = grouped.withColumn("study_id", F.col("report_id"))
    assert len({x.report_id for x in linkage.merge_groups(links, [4, 5]).collect()}) == 2
    assert len({x.report_id for x in linkage.split_groups(links, [2, 3]).collect()}) == 5


CONFLICTS = [
    ("Phase I/II study", "phase 2 trial", True),
    ("phase II", "Phase 2", False),
    ("Phase IIb study", "phase 2a study", True),
    ("KEYNOTE-024 results", "KEYNOTE 024: update", False),
    ("KEYNOTE-024 results", "keynote 042", True),
    ("CheckMate 067(2016)", "CheckMate 67", False),
    ("PD-L1 in cancer", "PD-L2 in cancer", False),
    ("Alpha 1 outcomes", "Alpha 2 outcomes", True),
    ("Alpha 1 outcomes", "Beta 2 outcomes", False),
    ("12-24 months of follow-up", "24 months later", True),
    ("12\u201324 months", "12/24 month data", False),
    ("5-year outcome", "5 yr outcome", False),
    ("week 12 data", "12 weeks of data", False),
    ("Study no. 007", "trial number 7", False),
    ("Study 1", "Study 2", True),
    ("2.50 years", "2.5-year", False),
    ("Volume 12", "Volume 13", False),
    ("cohort 1, page 9", "cohort 2", False),
    ("", "Phase 1", False),
]


def test_title_numbers(spark):
    df = spark.createDataFrame(CONFLICTS, "a string, b string, want boolean")
    n = linkage.title_numbers
    got = df.select("a", "b", "want", linkage.numbers_conflict(n(F.col("a")), n(F.col("b"))).alias("got"), linkage.numbers_conflict(n(F.col("b")), n(F.col("a"))).alias("back")).collect()
    assert [(r.a, r.b) for r in got if not r.got == r.back == r.want] == []


def test_composed_titles_and_evidence(spark):
    r = [(1, "Caf\u00e9 care after 5 years", ["McDonald J"], 2020), (2, "Cafe\u0301 care after 5 years", ["Mcdonald, K"], 2021), (3, "Cafe\u0301 care after 6 years", ["McDonald J"], 2020)]
    df = spark.createDataFrame([(i, i, t, a, y, None, None, None) for i, t, a, y in r], "occurrence_id int, input_pos int, title string, authors array<string>, year int, doi string, pmid string, pmcid string")
    assert [(x.a, x.b, x.evidence) for x in linkage.link_pairs(df).collect()] == [(1, 2, "Titles 100% alike, same year 2020, same first author McDonald")]


def test_short_titles(spark):
    titles = ["abcde", "abcdef", "abcdf", "a", "ab", "abcdxe", "abcdefghi", "abcdefghij", "bcdefghij", "abcdefghijk", "b", "ba"]
    got = {tuple(sorted((r.a, r.b))) for r in linkage.alike_titles(spark.createDataFrame([(t,) for t in titles], "title string")).collect()}
    assert got == {tuple(sorted(p)) for p in itertools.combinations(titles, 2) if similarity.ratio(*p) >= 90} and len(got) > 3


def test_pool(spark):
    kind = "occurrence_id int, title string, authors array<string>, year int, doi string, pmid string, pmcid string"
    pool = spark.createDataFrame([(1, "A long title about the care of adults", ["Roe A"], 2020, None, None, None), (2, "Another title, not near", [], None, "10.1/x", None, None), (3, "Same title of two papers", ["Doe B"], 2001, None, None, None), (4, "", [], None, None, None, None)], kind)
    found = spark.createDataFrame([(11, "A long title about the care of adult", ["Roe A"], 2021, None, None, None), (12, "Unlike", [], None, "https://doi.org/10.1/X", None, None), (13, "Same title of two papers", ["Doe B"], 2009, None, None, None), (14, "", [], None, None, None, None)], kind)
    assert sorted(map(tuple, linkage.pool_compare(pool, found).collect())) == [("found", 1), ("found", 2), ("missed", 3), ("missed", 4), ("new", 13), ("new", 14)]


def test_study_proposals_know_earlier_ones(spark):
    grouped = spark.createDataFrame([(i, i, i // 2) for i in range(6)], "occurrence_id int, report_id int, study_id int")
    own = spark.createDataFrame([(0, ["nct00000001", "2023-504892-39-00"]), (2, ["NCT00000001 "]), (4, ["2023-504892-39-00"]), (5, ["NCT9"]), (4, ["NCT9"])], "occurrence_id int, registry_ids array<string>")
    earlier = spark.createDataFrame([(1, [1, 3, 5])], "proposal_id int, occurrence_ids array<int>")
    got = lambda *e: {(tuple(r.occurrence_ids), tuple(r.registry_ids)) for r in linkage.study_proposals(own, grouped, *e).collect()}
    assert got() == {((0, 2), ("NCT00000001",)), ((0, 4), ("2023-504892-39-00",))} and got(earlier) == set()
    assert got(earlier.where("false")) == got()


def test_compare(spark):
    a = spark.createDataFrame([("k1", "1"), ("k2", None), ("k3", "x")], "k string, v string")
    b = spark.createDataFrame([("k1", "1.0"), ("k2", None), ("k4", "y")], "k string, v string")
    assert [r.state for r in compare.reconcile(a, b, ["k"], "v").orderBy("k").collect()] == ["agreed", "neither", "first_only", "second_only"]
    fixed = compare.overlay(a, spark.createDataFrame([("k1", "7", 1), ("k1", "8", 2)], "k string, v string, seq int"), "k", "v")
    assert [(r.v, r.corrected) for r in fixed.orderBy("k").collect()] == [("8", True), (None, False), ("x", False)]


def test_grid(spark):
    df = spark.createDataFrame([(1, "item 10", ["a", "b"]), (2, "item 9", []), (3, "", None)], "p int, n string, v array<string>")
    assert [r.p for r in grid.filtered(df, {"v": {"values": ["(empty)"]}}).orderBy("p").collect()] == [2, 3]
    assert [r.p for r in grid.ordered(df, [("n", False)], "p").collect()] == [2, 1, 3] and [r.p for r in grid.ordered(df, [("n", True)], "p").collect()] == [1, 2, 3]
    assert [r.p for r in grid.saved_view(df, '{"query": "iteme 10", "fields": ["n"], "columns": ["p"]}', "p").collect()] == [1]


def test_screening(spark):
    c = "array<struct<id:string,status:string,verified:boolean,failed_check:string>>"
    df = spark.createDataFrame([([("c1", "not_met", True, None), ("c2", "not_met", False, None)],), ([("c2", "not_met", False, None)],), ([],)], f"c {c}")
    got = [r[0] for r in df.select(screening.proposal(F.col("c"), F.lit(False), F.lit(False))).collect()]
    assert [(g.outcome, g.criterion) for g in got] == [("exclude", "c1"), ("include", None), ("include", None)]
    assert [r[0] for r in df.select(screening.ai_rank(F.col("c"))).collect()] == [1002, 1, 0]
    f = spark.createDataFrame([([("exclude", "a"), ("exclude", "b")], "include")], "f array<struct<outcome:string,criterion:string>>, a string")
    assert f.select(screening.conflict_kinds(F.lit("full_text"), F.col("f"), F.col("a"))).first()[0] == ["exclusion_reason", "audit_disagreement"]
    e = spark.createDataFrame([(1, 1, "provisional", "include"), (1, 2, "reveal", None), (1, 3, "final", "exclude")], "assignment int, seq int, kind string, outcome string")
    assert [(r.provisional, r.final, r.kept) for r in screening.reveals_kept(e).collect()] == [("include", "exclude", False)]


def test_titles_are_whole_lines(spark, sf):
    first = {d: t.split("\n")[0] for d, t in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect() if t}
    assert max(map(len, first.values())) > 200
    assert {r.occurrence_id: r.title for r in catalog.records(spark, sf).collect() if r.title} == {d: t for d, t in first.items() if t}
    titles = {r.ordinal: [x[6:] for x in r.entry.split("\n") if x.startswith("TI  - ")] for r in catalog_more.snk_ris_entries(spark, sf).collect()}
    assert all(titles[d] == [" ".join(t.split())] for d, t in first.items() if " ".join(t.split()))


def test_flow_balances(spark, sf):
    from veritrail.plans.catalog import flow_checks

    assert all(r.ok for r in flow_checks(spark, sf).collect())


def test_appraisal(spark):
    low = {"1.1": "Y", "1.2": "Y", "1.3": "N", "2.1": "N", "2.2": "PN", "2.6": "Y", "3.1": "Y", "4.1": "N", "4.2": "N", "4.3": "N", "5.1": "Y", "5.2": "N", "5.3": "N"}
    df = spark.createDataFrame([(1, low), (2, {**low, "1.2": "N"}), (3, {**low, "4.2": "NI"})], "i int, a map<string,string>")
    assert [(r.D1, r.overall) for r in appraisal.judge(df, "a").orderBy("i").collect()] == [("low", "low"), ("high", "high"), ("low", "some_concerns")]
    qs = [appraisal.Question("1"), appraisal.Question("2", ("1",), ("Y",)), appraisal.Question("3", ("2",), ("Y", "N"), every=True)]
    m = spark.createDataFrame([(1, {}), (2, {"1": "Y"}), (3, {"1": "N"})], "i int, a map<string,string>")
    got = m.orderBy("i").select(*appraisal.applies(qs, F.col("a")).values()).collect()
    assert [tuple(r) for r in got] == [("yes", "pending", "pending"), ("yes", "yes", "pending"), ("yes", "no", "no")]


def test_extraction(spark):
    lines = spark.createDataFrame([("d", 1, 1, "Age: 64", 0.0, 50.0, 0.0, 10.0), ("d", 1, 2, "Sex", 0.0, 30.0, 20.0, 30.0), ("d", 1, 3, "male", 40.0, 60.0, 20.0, 30.0), ("d", 1, 4, "Results", 0.0, 40.0, 40.0, 50.0), ("d", 1, 5, "went well", 0.0, 40.0, 60.0, 70.0), ("d", 1, 6, "Discussion", 0.0, 40.0, 80.0, 90.0)], "doc string, page int, line int, text string, x0 double, x1 double, y0 double, y1 double")
    assert [(r.label, r.value) for r in extraction.inline_candidates(lines).collect()] == [("Age", "64")]
    assert ("Sex", "male") in [(r.label, r.value) for r in extraction.beside_candidates(lines, 200.0).collect()]
    assert rows(extraction.prose(lines, "^Results", "^Discussion")) == [("d", "went well")]
    assert [r.line for r in extraction.search_lines(lines, "went well").collect()] == [5]
    cells = spark.createDataFrame([("d", 1, 1, i, j, t) for i, r in enumerate([["", "Drug"], ["Women (n = 5)", ""], ["Deaths", "3"], ["Deaths", "4"]]) for j, t in enumerate(r)], "doc string, page int, table int, row int, col int, text string")
    cand = extraction.table_candidates(cells)
    assert ("Deaths", "Women", "Drug", "3") in [(r.label, r.section, r.column, r.value) for r in cand.collect()]
    keyed = extraction.generated_rows(cand.where("value <> ''"), r"^(\w+)$", "Drug", 5)
    assert [(r.key, r.value) for r in keyed.orderBy("nth").collect()] == [("Deaths", "3"), ("Deaths_2", "4")]
    fields = spark.createDataFrame([("deaths", ["death", "died"], "women", None)], "field string, aliases array<string>, section string, column string")
    won = extraction.winners(extraction.scored(cand.where("value <> ''"), fields))
    assert [(r.status, r.value) for r in won.collect()] == [("ambiguous", None)]
    table = spark.createDataFrame([("d", 1, 1, i, j, t) for i, r in enumerate([["Name", "N"], ["a", "1"], ["Name", "N"], ["b", "2"], ["", " "]]) for j, t in enumerate(r)], cells.schema)
    assert [(r.name, r.n) for r in extraction.records(table, {"name": ["name"], "n": ["n", "number"]}).orderBy("row").collect()] == [("a", "1"), ("b", "2")]
    merged = spark.createDataFrame([("d", 1, 1, 0, 0, "x"), ("d", 1, 1, 1, 0, "a\nb"), ("d", 1, 1, 1, 1, "1\n2")], cells.schema)
    assert [(r.row, r.col, r.text) for r in extraction.split_merged_rows(merged).orderBy("row", "col").collect()] == [(0, 0, "x"), (1, 0, "a"), (1, 1, "1"), (2, 0, "b"), (2, 1, "2")]
    i = spark.createDataFrame([("1.0", "0.5", "2.0"), ("1.9", "0.5", "2.0"), ("3", "0.5", "2.0"), ("1", "2", "0.5")], "e string, l string, u string")
    assert [r[0] for r in i.select(extraction.interval_problem(F.col("e"), F.col("l"), F.col("u"), F.lit(True))).collect()] == [None, "off_centre", "outside", "reversed"]


def test_layout(spark):
    w = spark.createDataFrame([("d", 1, 1, "b", 20.0, 1.0, 30.0, 11.0, 0), ("d", 1, 2, "a", 0.0, 0.0, 10.0, 10.0, 0), ("d", 1, 3, "c", 0.0, 20.0, 10.0, 30.0, 90)], "doc string, page int, word int, text string, x0 double, y0 double, x1 double, y1 double, direction int")
    assert [(r.text, r.start, r.end) for r in layout.line_texts(layout.word_lines(w)).orderBy("line").collect()] == [("a b", 0, 3), ("c", 4, 5)]
    assert layout.reading_frame(w).first()["direction"] == 0
    s = spark.createDataFrame([("d", 1, 5.0, 0.0, 10.0), ("d", 1, 5.0, 12.0, 20.0), ("d", 1, 5.0, 40.0, 50.0)], "doc string, page int, y double, x0 double, x1 double")
    assert [(r.x0, r.x1) for r in layout.joined_rules(s).orderBy("x0").collect()] == [(0.0, 20.0), (40.0, 50.0)]
    p = spark.createDataFrame([("d", 1, "", 1), ("d", 2, "�� good text here and more", 0), ("d", 3, "all fine text of a page", 1)], "doc string, page int, text string, images int")
    assert [r.kind for r in layout.triage(p).orderBy("page").collect()] == ["ocr", "broken", "text"]
    b = spark.createDataFrame([("d", 1, 1, 0.0, 0.0, 40.0, 10.0), ("d", 1, 2, 60.0, 0.0, 90.0, 10.0), ("d", 1, 3, 0.0, 20.0, 40.0, 30.0), ("d", 1, 4, 60.0, 20.0, 90.0, 30.0)], "doc string, page int, item int, x0 double, y0 double, x1 double, y1 double")
    assert [r.item for r in layout.reading_order(b).orderBy("place").collect()] == [1, 3, 2, 4]
