import json

from pyspark.sql import functions as F

from veritrail.operators import enrichment, identity


def test_identity(spark):
    e = spark.createDataFrame([(1, 1, "merge", [1, 2], "doi"), (1, 2, "merge", [2, 3], "title"), (1, 3, "split", [1], "lead"), (1, 4, "merge", [8, 9], "pmid"), (1, 5, "split", [9], "lead")], "project_id int, seq int, kind string, occurrence_ids array<int>, said string")
    assert [(r.occurrence_ids, r.why) for r in identity.why(e).collect()] == [([2, 3], ["doi", "title"])]
    r = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "a")], "revision_id string, parent_id string")
    assert [x.revision_id for x in identity.chain(r, "c").orderBy("depth").collect()] == ["c", "b", "a"]
    rec = spark.createDataFrame([(1, 1, "s1"), (2, 2, "s2"), (3, 3, "s1")], "occurrence_id int, input_pos int, search_id string")
    links = spark.createDataFrame([(1, "r1", "same_record"), (2, "r1", "same_record"), (3, "r3", "none")], "occurrence_id int, report_id string, relation string")
    assert [(v.records, v.searches, v.relation) for v in identity.report_view(rec, links).orderBy("first").collect()] == [([1, 2], ["s1", "s2"], "same_record"), ([3], ["s1"], "none")]
    tags = spark.createDataFrame([("d", 1, 0, "BRCA", "gene"), ("d", 2, 3, "BRCA", "gene"), ("d", 3, 9, "nope", "x")], "doc string, n int, start int, surface string, kind string")
    texts = spark.createDataFrame([("d", "BRCA and BRCA1 or BRCA")], "doc string, text string")
    assert [(t.start, t.end) for t in identity.place_tags(tags, texts).orderBy("start").collect()] == [(0, 4), (18, 22)]


def test_enrichment(spark):
    body = json.dumps({"doi": "https://doi.org/10.1/A", "title": "<i>T</i> x", "pubYear": "2001", "pmid": "5", "abstractText": "a"})
    other = json.dumps({"message": {"DOI": "10.1/b", "title": ["U"], "issued": {"date-parts": [[1999]]}}})
    a = enrichment.works(spark.createDataFrame([("k", body)], "key string, body string"), "europepmc")
    b = enrichment.works(spark.createDataFrame([("k", other)], "key string, body string"), "crossref")
    rec = spark.createDataFrame([("k", "10.1/a", None, None, None, None)], "key string, doi string, pmid string, title string, year int, abstract string")
    m = enrichment.merged(rec, [b, a]).first()
    assert (m.title, m.title_from, m.year, m.pmid, m.doi_from, m.refused) == ("T x", "europepmc", 2001, "5", "record", ["crossref"])
    oa = json.dumps({"oa_locations": [{"url": "u", "url_for_pdf": None, "host_type": "repository"}, {"url": "v", "url_for_pdf": "p"}]})
    assert [(x.url, x.pdf) for x in enrichment.locations(spark.createDataFrame([("k", oa)], "key string, body string")).orderBy("rank").collect()] == [("u", False), ("v", True)]
    u = spark.createDataFrame([("10.1/a", [("Retraction", "doi:10.1/A")]), ("10.1/b", [("retraction", "10.1/z")])], "doi string, u array<struct<kind:string,target:string>>")
    assert [r[0] for r in u.orderBy("doi").select(enrichment.retracted(F.col("u"), F.col("doi"))).collect()] == [True, False]
    who = spark.createDataFrame([("k", "10.1101/x", None), ("l", None, "PMC1")], "key string, doi string, pmcid string")
    assert {(r.key, r.source) for r in enrichment.lookups(who).collect()} == {("k", "biorxiv"), ("k", "semanticscholar"), ("k", "core"), ("l", "pmc")}
    acc = spark.createDataFrame([("k", 1, "5", ["a"]), ("k", 2, "6", ["b"]), ("k", 9, "7", ["a"])], "key string, event_seq int, value string, anchor_ids array<string>")
    q = spark.createDataFrame([("a", "qa"), ("b", "qb")], "anchor_id string, quote string")
    assert [(r.value, r.quotes) for r in enrichment.extracted_values(acc, q, 5).collect()] == [("6", ["qb"])]
