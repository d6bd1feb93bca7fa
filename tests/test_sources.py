import json
import time

import pytest
from pyspark.errors import PythonException

from veritrail.operators import ledger
from veritrail.sources import records, reference, sinks
from veritrail.streaming import ledger_stream, windows

RIS = "TY  - JOUR\nTI  - One\n  title\nAU  - Smith, J\nAU  - Doe, A\nPY  - 2020/01\nDO  - https://doi.org/10.1/X\nN1  - see NCT01234567\nER  - \n\nTY  - JOUR\nT1  - Two\nER  - \n"
NBIB = "PMID- 12\nTI  - A long\n      title\nAU  - Smith J\nCN  - Group\nDP  - 2019 May\nLID - 10.1/y [doi]\nPT  - Journal Article\n\nPMID- 13\nTI  - B\n"
WOS = "FN Clarivate\nVR 1.0\nPT J\nAU Smith, J\n   Doe, A\nTI T one\n   goes on\nPY 2001\nUT WOS:1\nER\n\nEF\n"
XML = "<S><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><ArticleTitle>T <i>x</i></ArticleTitle><Abstract><AbstractText Label='AIM'>a</AbstractText><AbstractText>b</AbstractText></Abstract><AuthorList><Author><LastName>Roe</LastName><Initials>B</Initials></Author><Author><CollectiveName>G</CollectiveName></Author></AuthorList><Journal><Title>J</Title><JournalIssue><PubDate><MedlineDate>2003 Jan</MedlineDate></PubDate></JournalIssue></Journal></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType='doi'>10.1/q</ArticleId><ArticleId IdType='pmc'>PMC9</ArticleId></ArticleIdList></PubmedData></PubmedArticle></S>"


def read(spark, tmp_path, text, format):
    path = tmp_path / f"{format}.txt"
    path.write_text(text)
    return records.read_records(spark, f"file://{path}", format).orderBy("ordinal").collect()


def test_formats(spark, tmp_path):
    a, b = read(spark, tmp_path, RIS, "ris")
    assert (a.title, a.authors, a.year, a.doi, a.registry_ids, a.provider_record_id) == ("One title", ["Smith, J", "Doe, A"], 2020, "10.1/X", ["NCT01234567"], "https://doi.org/10.1/X") and b.title == "Two" and b.publication_types == ["JOUR"]
    a, b = read(spark, tmp_path, NBIB, "nbib")
    assert (a.title, a.authors, a.doi, a.pmid, a.year) == ("A long title", ["Smith J", "Group"], "10.1/y", "12", 2019) and b.pmid == "13"
    (a,) = read(spark, tmp_path, WOS, "wos")
    assert (a.title, a.authors, a.year) == ("T one goes on", ["Smith, J", "Doe, A"], 2001)
    (a,) = read(spark, tmp_path, "UT\tTI\tAU\nW1\tT\tA B; C D\n", "wos")
    assert a.authors == ["A B", "C D"]
    (a,) = read(spark, tmp_path, 'EID,Title,Authors,Abstract\ne1,T,"Smith J., Doe A.",[No abstract available]\n', "scopus")
    assert a.authors == ["Smith J.", "Doe A."] and a.abstract is None
    (a,) = read(spark, tmp_path, "EudraCT Number,Full Title,Phase,Status\n2004-000001-12,T,2,Open\n", "registry")
    assert a.publication_types == ["Phase: 2", "Status: Open"] and a.registry_ids == ["2004-000001-12"]
    a, b = read(spark, tmp_path, "our list;;\nArticle Title;PubMed ID;Year\nT;5;2001\nU;;\n", "list")
    assert (a.title, a.pmid, a.year, b.title) == ("T", "5", 2001, "U")
    (a,) = read(spark, tmp_path, XML, "pubmed_xml")
    assert (a.title, a.abstract, a.authors, a.year, a.doi, a.pmcid) == ("T x", "AIM: a\n\nb", ["Roe B", "G"], 2003, "10.1/q", "PMC9")


@pytest.mark.parametrize(("format", "text"), [("ris", "TY  - JOUR\nTI  - x\n"), ("wos", WOS.replace("EF\n", "")), ("nbib", "TI  - x\n"), ("scopus", "EID,Title\na\n"), ("list", "a,b\n1,2\n")])
def test_broken_files(spark, tmp_path, format, text):
    with pytest.raises(PythonException):
        read(spark, tmp_path, text, format)


def test_ris_gives_its_pmid():
    """PMIDs were not read, and src_ris made them up from the title."""
    own = lambda line: [r["pmid"] for r in records.parse_ris(f"TY  - JOUR\nTI  - x\n{line}\nER  - \n", "ris")]
    assert own("AN  - PMID 12") == own("N1  - see NCT01234567\nN1  - PMID: 12") == own("UR  - https://pubmed.ncbi.nlm.nih.gov/12/") == ["12"]
    assert own("N1  - Comment on PMID: 12") == own("AN  - 12") == [None]


@pytest.mark.parametrize("text", ["TY  - JOUR\nTI  - One\n TY  - JOUR\n TI  - Two\n ER  - \nER  - \n", "TY  - JOUR\nTI  - One\n  AU  - Doe\nER  - \n", "TY  - JOUR\nTI  - One\nER  - TI  - Two\n"])
def test_ris_loses_no_field_in_another(text):
    with pytest.raises(ValueError):
        list(records.parse_ris(text, "ris"))


def test_reference(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"a": {"b": [1, None]}, "s": "x"}))
    leaves = reference.json_reference(spark, f"file://{tmp_path}/r.json")
    plan = spark.createDataFrame([("f", "/a/b/0"), ("g", "/a/b/1"), ("h", "/no"), ("i", "/s")], "field string, pointer string")
    got = {r.field: (r.found, r.expected) for r in reference.bind(plan, leaves).collect()}
    assert got == {"f": (True, "1"), "g": (True, None), "h": (False, None), "i": (True, "x")}
    (tmp_path / "r.csv").write_text("k,v\na,1\nb,2\na,3\n")
    assert {tuple(r) for r in reference.lookup(reference.csv_reference(spark, f"file://{tmp_path}/r.csv")).collect()} == {("a", "3"), ("b", "2")}


def test_sinks(spark, tmp_path):
    path = tmp_path / "a.ris"
    path.write_text(RIS)
    own = records.read_records(spark, f"file://{path}", "ris")
    sinks.write_ris(own, f"file://{tmp_path}/out", {"C1": "occurrence_id"})
    again = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert [r["title"] for r in records.parse_ris(again, "ris")] == ["One title", "Two"]
    df = spark.createDataFrame([(1, "=1+1", 1), (2, "-5", 2)], "event_seq int, t string, x int")
    assert [r[0] for r in df.select(sinks.sheet_safe(df["t"])).collect()] == ["'=1+1", "-5"]
    m = sinks.write_bundle({"t": df}, f"file://{tmp_path}/bundle", cutoff=1)
    listed = spark.createDataFrame(m.collect(), m.schema)
    assert spark.read.parquet(f"file://{tmp_path}/bundle/t").count() == 1 and sinks.verify_bundle(spark, f"file://{tmp_path}/bundle", listed).count() == 0
    new = sinks.upsert(df, spark.createDataFrame([(1, "n", 9), (3, "o", 9)], df.schema), ["event_seq"])
    assert {(r.event_seq, r.t) for r in new.collect()} == {(1, "n"), (2, "-5"), (3, "o")}


def test_ledger_stream(spark, tmp_path):
    base = spark.createDataFrame([(1, i, f"e{i}", "t", "a", "now", "{}") for i in range(1, 5)], "project_id long, seq long, event_id string, type string, actor_id string, recorded_at string, payload string")
    sealed = sorted((r.asDict() for r in ledger.chained(base).collect()), key=lambda r: r["seq"])
    folder = tmp_path / "events"
    folder.mkdir()
    for n, part in enumerate([[sealed[1]], [sealed[0], sealed[1]], [sealed[2], {**sealed[3], "prev_hash": "x"}]]):
        (folder / f"{n}.json").write_text("\n".join(json.dumps(r) for r in part))
        time.sleep(0.05)
    stream = ledger_stream.ingest(spark, f"file://{folder}")
    q = stream.writeStream.format("memory").queryName("led").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.seq, r.status) for r in spark.sql("select * from led").collect()}
    assert {(1, "accepted"), (2, "accepted"), (3, "accepted"), (4, "broken_link")} <= got


def test_windows(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    assert windows.tumbling(events, "ts", "1 hour", ["event_type"], "value").agg({"n": "sum"}).first()[0] == events.count()
    assert windows.sessions(events, "ts", "1 hour", ["user_id"]).agg({"n": "sum"}).first()[0] == events.count()
