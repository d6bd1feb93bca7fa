"""Further queries: joins, sets, scalars, extraction, appraisal and audit on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritrail.functions import canonical, numbers, spans, statistics, text
from veritrail.operators import appraisal, extraction, joins, ledger, ranking, screening
from veritrail.plans.catalog import judged, t
from veritrail.plans.registry import query
from veritrail.sources import sinks


@query(
    "join_coalesce_key",
    """SELECT o.o_orderkey, n.n_name FROM orders o LEFT JOIN nation n ON n.n_nationkey = coalesce(CASE WHEN o.o_orderkey % 3 = 0 THEN o.o_orderkey % 25 END, o.o_custkey % 25)""",
)
def join_coalesce_key(spark, sf_dir):
    k = F.col("o_orderkey")
    own = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return joins.join_first_key(own, [F.when(k % 3 == 0, k % 25), F.col("o_custkey") % 25], t(spark, sf_dir, "nation"), "n_nationkey").select("o_orderkey", "n_name")


@query(
    "join_source_match",
    """SELECT c.c_custkey, coalesce(a.r_name, b.r_name, d.r_name) AS region FROM customer c LEFT JOIN region a ON a.r_regionkey = c.c_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey AND c.c_custkey % 2 = 0 LEFT JOIN region b ON b.r_regionkey = n.n_regionkey LEFT JOIN region d ON d.r_name = 'ASIA'""",
)
def join_source_match(spark, sf_dir):
    regions = t(spark, sf_dir, "region")
    k = F.col("c_custkey")
    nation = t(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey")).join(regions, "r_regionkey").select("n_nationkey", "r_name")
    sources = [(k, regions, "r_regionkey", "r_name"), (F.when(k % 2 == 0, F.col("c_nationkey")), nation, "n_nationkey", "r_name"), (F.lit("ASIA"), regions, "r_name", "r_name")]
    return joins.first_match(t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), sources, "region").drop("c_nationkey")


@query(
    "agg_filter_progress",
    """SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'purchase' AND value > 50) AS large, count(*) AS all_events FROM events GROUP BY 1""",
)
def agg_filter_progress(spark, sf_dir):
    kind = F.col("event_type")
    return joins.counts(t(spark, sf_dir, "events"), ["user_id"], {"clicks": kind == "click", "large": (kind == "purchase") & (F.col("value") > 50), "all_events": F.lit(True)})


@query(
    "agg_array_members",
    """SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS members, min(n_nationkey) AS first FROM nation GROUP BY 1""",
)
def agg_array_members(spark, sf_dir):
    nation = t(spark, sf_dir, "nation")
    least = joins.first_open(nation, "n_regionkey", "n_nationkey", ["n_nationkey"]).withColumnRenamed("next", "first")
    return joins.members(nation, "n_regionkey", "n_name").join(least, "n_regionkey").withColumn("members", F.array_join("members", "|"))


@query(
    "set_operations",
    """WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R')
    SELECT 'both' AS kind, count(*) AS n FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'only_a', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'any', count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)""",
)
def set_operations(spark, sf_dir):
    of = lambda f: t(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("k"))
    return joins.compare_sets(of("A"), of("R"), "k")


@query(
    "set_subset",
    """WITH c AS (SELECT o_custkey, list_distinct(list(o_orderpriority)) AS p FROM orders GROUP BY 1) SELECT o_custkey, len([x FOR x IN p IF x NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')]) = 0 AS covered FROM c""",
)
def set_subset(spark, sf_dir):
    return joins.covered(t(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"])


@query(
    "link_known_includes",
    """WITH i AS (SELECT c_custkey, unnest(['doi:10.1/' || c_custkey, 'pmid:' || c_custkey * 2]) AS id FROM customer), k AS (SELECT 'doi:10.1/' || s_suppkey AS id FROM supplier UNION SELECT 'pmid:' || s_suppkey FROM supplier)
    SELECT DISTINCT c_custkey FROM i WHERE id IN (SELECT id FROM k)""",
)
def link_known_includes(spark, sf_dir):
    ids = lambda key, double: F.array(F.concat(F.lit("doi:10.1/"), F.col(key).cast("string")), F.concat(F.lit("pmid:"), (F.col(key) * double).cast("string")))
    return joins.meeting(t(spark, sf_dir, "customer"), "c_custkey", ids("c_custkey", 2), t(spark, sf_dir, "supplier"), ids("s_suppkey", 1))


@query(
    "flt_valid_decisions",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN ['unknown_outcome'] WHEN event_type = 'signup' THEN ['criterion_missing'] ELSE [] END AS problems FROM events""",
)
def flt_valid_decisions(spark, sf_dir):
    outcome = F.when(F.col("event_type") == "error", "what").when(F.col("event_type") == "signup", "exclude").otherwise("include")
    decision = F.struct(outcome.alias("outcome"), F.lit(None).cast("string").alias("criterion"), F.lit(None).cast("string").alias("reason"))
    return t(spark, sf_dir, "events").select("event_id", screening.decision_problems(decision, F.lit("full_text"), F.array(F.lit("c1"))).alias("problems"))


@query(
    "scr_conflict_kinds",
    """WITH d AS (SELECT event_id % 50 AS item, list(DISTINCT CASE WHEN value > 100 THEN 'include' ELSE 'exclude' END) AS o FROM events GROUP BY 1) SELECT item, CASE WHEN len(o) > 1 THEN ['human_disagreement'] ELSE [] END AS kinds FROM d""",
)
def scr_conflict_kinds(spark, sf_dir):
    own = t(spark, sf_dir, "events").groupBy((F.col("event_id") % 50).alias("item")).agg(F.collect_list(F.struct(F.when(F.col("value") > 100, "include").otherwise("exclude").alias("outcome"), F.lit("c").alias("criterion"))).alias("finals"))
    return own.select("item", screening.conflict_kinds(F.lit("title"), F.col("finals"), F.lit(None).cast("string")).alias("kinds"))


@query(
    "scr_model_proposals",
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'exclude' ELSE 'include' END AS outcome, CASE WHEN p_size % 3 = 0 THEN 'size' END AS criterion, CASE WHEN p_size % 3 = 0 THEN 1001 WHEN p_size % 3 = 1 THEN 1 ELSE 0 END AS rank FROM part""",
)
def scr_model_proposals(spark, sf_dir):
    k = F.col("p_size") % 3
    reading = F.array(F.struct(F.lit("size").alias("id"), F.when(k < 2, "not_met").otherwise("met").alias("status"), (k == 0).alias("verified"), F.lit(None).cast("string").alias("failed_check")))
    p = screening.proposal(reading, F.lit(False), F.lit(False))
    return t(spark, sf_dir, "part").select("p_partkey", p["outcome"].alias("outcome"), p["criterion"].alias("criterion"), screening.ai_rank(reading).alias("rank"))


@query(
    "scr_reveals_kept",
    """WITH e AS (SELECT user_id AS a, event_id AS s, CASE event_type WHEN 'view' THEN 'provisional' WHEN 'click' THEN 'reveal' WHEN 'purchase' THEN 'final' END AS k, CASE WHEN value > 100 THEN 'include' ELSE 'exclude' END AS o FROM events WHERE event_type IN ('view', 'click', 'purchase')),
    r AS (SELECT a, s AS shown FROM e WHERE k = 'reveal'), p AS (SELECT r.a, r.shown, arg_max(o, s) AS provisional FROM r JOIN e ON e.a = r.a AND k = 'provisional' AND s < shown GROUP BY ALL), f AS (SELECT r.a, r.shown, arg_min(o, s) AS final FROM r JOIN e ON e.a = r.a AND k = 'final' AND s > shown GROUP BY ALL)
    SELECT p.a AS assignment, p.shown AS "at", provisional, final, provisional = final AS kept FROM p LEFT JOIN f ON f.a = p.a AND f.shown = p.shown""",
)
def scr_reveals_kept(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", "provisional").when(F.col("event_type") == "click", "reveal").when(F.col("event_type") == "purchase", "final")
    own = t(spark, sf_dir, "events").select(F.col("user_id").alias("assignment"), F.col("event_id").alias("seq"), kind.alias("kind"), F.when(F.col("value") > 100, "include").otherwise("exclude").alias("outcome"))
    return screening.reveals_kept(own)


@query(
    "sort_next_step",
    """WITH w AS (SELECT o_custkey, o_orderpriority, o_orderkey FROM orders WHERE o_orderstatus <> 'F') SELECT o_custkey, arg_min(o_orderkey, (o_orderpriority, o_orderkey)) AS next FROM w GROUP BY 1""",
)
def sort_next_step(spark, sf_dir):
    return joins.first_open(t(spark, sf_dir, "orders").where("o_orderstatus <> 'F'"), "o_custkey", "o_orderkey", ["o_orderpriority", "o_orderkey"])


@query(
    "json_canonical_hash",
    """SELECT event_id, sha256('payload' || chr(0) || '{"a":' || event_id || ',"k":' || (props::JSON->>'k') || '}') AS h FROM events""",
)
def json_canonical_hash(spark, sf_dir):
    body = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "a": '), F.col("event_id").cast("string"), F.lit("}"))
    return t(spark, sf_dir, "events").select("event_id", canonical.content_hash(canonical.canonical_json(body), "payload").alias("h"))


@query("json_pointers", "SELECT p_partkey, '/' || replace(replace(p_name || '~' || p_type || '/x', '~', '~0'), '/', '~1') AS pointer FROM part")
def json_pointers(spark, sf_dir):
    key = F.concat("p_name", F.lit("~"), "p_type", F.lit("/x"))
    return t(spark, sf_dir, "part").select("p_partkey", canonical.pointer(F.lit(""), key).alias("pointer"))


@query("json_field_ids", "SELECT p_partkey, sha256('spec:' || p_brand || ':' || p_name || ':' || p_partkey) AS id FROM part")
def json_field_ids(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", canonical.field_id(F.lit("spec"), F.col("p_brand"), F.col("p_name"), F.col("p_partkey").cast("string")).alias("id"))


@query("txt_label_order", "SELECT n_nationkey, (n_nationkey // 5) || '.' || (n_nationkey % 5 + 1) AS next, n_nationkey > 7 AS later FROM nation")
def txt_label_order(spark, sf_dir):
    k = F.col("n_nationkey")
    label = F.concat(F.floor(k / 5).cast("string"), F.lit("."), (k % 5).cast("string"))
    return t(spark, sf_dir, "nation").select("n_nationkey", text.next_label(label).alias("next"), text.label_after(label, F.lit("1.2")).alias("later"))


@query(
    "str_strip_markup",
    r"""SELECT page_id, nullif(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g')), '') AS body FROM pages""",
)
def str_strip_markup(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", text.strip_markup(F.col("html")).alias("body"))


@query("str_highlights")
def str_highlights(spark, sf_dir):
    own = t(spark, sf_dir, "documents").select("doc_id", spans.highlights({"function": ["the", "and"], "article": ["la", "der"]})("text").alias("h"))
    return own.select("doc_id", F.size("h").alias("n"), F.get("h", F.lit(0))["start"].alias("first"))


@query("str_words_folded", "SELECT r_regionkey, [lower(x) FOR x IN string_split(r_name, ' ')] AS words FROM region")
def str_words_folded(spark, sf_dir):
    return t(spark, sf_dir, "region").select("r_regionkey", text.words_folded(F.col("r_name")).alias("words"))


@query(
    "num_tokens",
    """SELECT p_partkey, [p_size::VARCHAR, p_retailprice::DECIMAL(10,1)::VARCHAR] AS tokens FROM part""",
)
def num_tokens(spark, sf_dir):
    sentence = F.concat(F.lit("n="), F.col("p_size").cast("string"), F.lit(" for "), F.col("p_retailprice").cast("decimal(10,1)").cast("string"), F.lit(" EUR"))
    return t(spark, sf_dir, "part").select("p_partkey", numbers.numbers_in(sentence).alias("tokens"))


@query(
    "num_well_formed",
    """SELECT p_partkey, CASE WHEN p_size * 4 > 100 THEN '0 to 100 expected' END AS problem FROM part""",
)
def num_well_formed(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", numbers.well_formed((F.col("p_size") * 4).cast("string"), "percentage").alias("problem"))


@query("date_parse", "SELECT o_orderkey, o_orderdate::DATE AS d FROM orders")
def date_parse(spark, sf_dir):
    d = F.col("o_orderdate")
    printed = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "dd.MM.yyyy"))
    return t(spark, sf_dir, "orders").select("o_orderkey", numbers.as_date(printed).alias("d"))


@query(
    "ext_label_value",
    """SELECT p_partkey AS doc, label, value FROM part, LATERAL (VALUES ('Name', p_name), ('Size', p_size::VARCHAR)) v(label, value)""",
)
def ext_label_value(spark, sf_dir):
    """'Label: value' lines of small texts made from parts."""
    body = F.concat(F.lit("Name: "), "p_name", F.lit("\nno label here\nSize:  "), F.col("p_size").cast("string"))
    own = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), F.lit(1).alias("page"), F.posexplode(F.split(body, "\n")).alias("line", "text"))
    return extraction.inline_candidates(own).select("doc", "label", "value")


@query(
    "ext_table_cells",
    """WITH a AS (SELECT l_returnflag AS label, l_linestatus AS col, sum(l_quantity::DECIMAL(18,2))::VARCHAR AS value FROM lineitem GROUP BY 1, 2)
    SELECT label, 'status ' || col AS column, value FROM a""",
)
def ext_table_cells(spark, sf_dir):
    """A cross table of lineitem as cells, read back as candidates."""
    own = t(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("string").alias("v"))
    place = lambda c, values: F.array_position(F.array(*map(F.lit, values)), F.col(c)).cast("int")
    row, col = place("l_returnflag", ["A", "N", "R"]), place("l_linestatus", ["F", "O"])
    cell = lambda df, r, c, v: df.select(F.lit("d").alias("doc"), F.lit(1).alias("page"), F.lit(1).alias("table"), r.alias("row"), c.alias("col"), v.alias("text")).distinct()
    cells = cell(own, row, col, F.col("v")).union(cell(own, row, F.lit(0), F.col("l_returnflag"))).union(cell(own, F.lit(0), col, F.concat(F.lit("status "), "l_linestatus")))
    return extraction.table_candidates(cells).select("label", "column", "value")


@query("ext_search_lines")
def ext_search_lines(spark, sf_dir):
    own = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.lit(1).alias("page"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return extraction.search_lines(own, "of the and").select("doc", "line", "passage")


@query(
    "rob_judgements",
    """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'high' ELSE 'some_concerns' END AS d1, CASE p_size % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'high' ELSE 'some_concerns' END AS overall FROM part""",
)
def rob_judgements(spark, sf_dir):
    calm = {"1.1": "Y", "1.3": "N", "2.1": "N", "2.2": "N", "2.6": "Y", "3.1": "Y", "4.1": "N", "4.2": "N", "4.3": "N", "5.1": "Y", "5.2": "N", "5.3": "N"}
    k = F.col("p_size") % 3
    entries = [x for q, a in calm.items() for x in (F.lit(q), F.lit(a))]
    answers = F.create_map(*entries, F.lit("1.2"), F.when(k == 0, "Y").when(k == 1, "N").otherwise("NI"))
    own = t(spark, sf_dir, "part").select("p_partkey", "p_size", answers.alias("answers"))
    return appraisal.judge(own, "answers").select("p_partkey", F.col("D1").alias("d1"), "overall")


@query("stat_elusion")
def stat_elusion(spark, sf_dir):
    strata = screening.audit_strata(judged(spark, sf_dir), "a", F.col("doc_id") % 3 == 0, F.col("rel"))
    kind = T.StructType([T.StructField(n, T.DoubleType()) for n in ("estimate", "lower", "upper")])

    @F.pandas_udf(kind)
    def run(rows):
        import pandas as pd

        return pd.DataFrame([statistics.elusion([(s["population"], s["sampled"], s["relevant"]) for s in r]) for r in rows], columns=["estimate", "lower", "upper"])

    return strata.agg(F.collect_list(F.struct("population", "sampled", "relevant")).alias("s")).select(run("s").alias("i")).select("i.*")


@query("stat_conformal")
def stat_conformal(spark, sf_dir):
    """The conformal threshold: only its place is computed on the driver, the score comes from a top-k."""
    scores = t(spark, sf_dir, "labels").where("quality = 1").select((F.pmod(F.xxhash64("doc_id"), F.lit(10_000)) / 10_000).alias("score"))
    try:
        k = statistics.conformal_order(scores.count(), 0.9, 0.05)
    except ValueError:
        return scores.where("false").select(F.lit(0).alias("place"), F.col("score").alias("threshold"))
    return scores.orderBy("score").limit(k).agg(F.lit(k).alias("place"), F.max("score").alias("threshold"))


@query("snk_ris_entries")
def snk_ris_entries(spark, sf_dir):
    own = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("ordinal"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.lit(None).cast("string").alias("abstract"), F.array("lang").alias("authors"), F.lit(2020).alias("year"), F.col("source").alias("journal"), F.lit(None).cast("string").alias("doi"), F.lit(None).cast("string").alias("pmid"), F.array().cast("array<string>").alias("registry_ids"), F.col("doc_id").cast("string").alias("provider_record_id"), "source")
    return sinks.ris_lines(own)


@query("snk_sheet_safe", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '''=' || c_name ELSE c_acctbal::DECIMAL(12,2)::VARCHAR END AS cell FROM customer")
def snk_sheet_safe(spark, sf_dir):
    raw = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("="), "c_name")).otherwise(F.col("c_acctbal").cast("decimal(12,2)").cast("string"))
    return t(spark, sf_dir, "customer").select("c_custkey", sinks.sheet_safe(raw).alias("cell"))


@query(
    "snk_upsert",
    """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'changed' ELSE c_mktsegment END AS segment FROM customer""",
)
def snk_upsert(spark, sf_dir):
    own = t(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return sinks.upsert(own, own.where("c_custkey % 4 = 0").withColumn("segment", F.lit("changed")), ["c_custkey"])


@query(
    "cache_replay",
    """WITH q AS (SELECT event_id, event_type AS hash, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS nth FROM events WHERE event_id % 2 = 0), a AS (SELECT value, event_type AS hash, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS nth FROM events WHERE event_id % 2 = 1)
    SELECT q.event_id AS seq, a.value AS answer FROM q LEFT JOIN a ON a.hash = q.hash AND a.nth = q.nth""",
)
def cache_replay(spark, sf_dir):
    own = t(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("hash"), "value")
    return ledger.replayed(own.where("seq % 2 = 0").drop("value"), own.where("seq % 2 = 1").withColumnRenamed("value", "answer")).select("seq", "answer")


@query(
    "stm_answer_chunks",
    """SELECT conv_id AS request, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY 1""",
)
def stm_answer_chunks(spark, sf_dir):
    from veritrail.streaming.ledger_stream import answer_texts

    return answer_texts(t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("request"), F.col("turn").alias("n"), F.col("text").alias("piece")))


@query(
    "win_carried_section",
    """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS asked FROM conversations""",
)
def win_carried_section(spark, sf_dir):
    own = t(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")).alias("u"))
    return ranking.carried(own, ["conv_id"], "turn", "u", "asked").select("conv_id", "turn", "asked")
