"""Queries of the library's own operators over the driver's tables.

Stand-ins: a document is a record (title: its first line), a user's
events are a ledger, `labels.quality` is a gold decision, orders are reference values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.functions import numbers, statistics, text
from veritrail.operators import agreement, compare, grid, joins, ledger, linkage, ranking, screening
from veritrail.plans.registry import query


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1))
    return t(spark, sf_dir, "documents").withColumn("title", text.plain_title(first))


TITLE = "trim(regexp_replace(regexp_replace(lower(split_part(coalesce(text, ''), chr(10), 1)), '[^\\p{L}\\p{M}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(
    "agg_count_identification",
    f"""WITH r AS (SELECT coalesce(source, 'unknown') AS source, {TITLE} AS title FROM documents)
    SELECT source, count(*) AS records, count(DISTINCT title) AS unique_reports, count(*) - count(DISTINCT title) AS duplicates FROM r GROUP BY 1""",
)
def agg_count_identification(spark, sf_dir):
    return agreement.identification_counts(titled(spark, sf_dir), "source", "title")


RULE = """WITH j AS (SELECT l.doc_id, quality = 1 AS rel, length(text) < 600 AS a, source IN ('src0', 'src5', 'src7') AS b
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""


def judged(spark, sf_dir):
    own = t(spark, sf_dir, "labels").join(t(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id")
    return own.select("doc_id", (F.col("quality") == 1).alias("rel"), (F.length("text") < 600).alias("a"), F.col("source").isin("src0", "src5", "src7").alias("b"))


@query(
    "agg_conf_screening",
    RULE
    + """, c AS (SELECT sum((rel AND NOT a)::INT)::BIGINT AS tp, sum((rel AND a)::INT)::BIGINT AS fn, sum((NOT rel AND a)::INT)::BIGINT AS tn, sum((NOT rel AND NOT a)::INT)::BIGINT AS fp FROM j)
    SELECT *, tp / (tp + fn) AS recall, tn / (tn + fp) AS specificity, (tn + fn) / (tp + fn + tn + fp) AS work_saved,
           (tn + fn) / (tp + fn + tn + fp) - (1 - tp / (tp + fn)) AS wss FROM c""",
)
def agg_conf_screening(spark, sf_dir):
    return agreement.confusion(judged(spark, sf_dir), F.col("rel"), F.col("a"))


@query(
    "agg_pairjudge",
    RULE
    + """, c AS (SELECT count(*) AS n, sum((rel AND NOT (a AND b))::INT)::BIGINT AS or_tp, sum((rel AND a AND b)::INT)::BIGINT AS or_fn,
      sum((NOT rel AND a AND b)::INT)::BIGINT AS or_tn, sum((a = rel AND b = rel)::INT)::BIGINT AS both_wrong, sum((a = b)::INT)::BIGINT AS same FROM j)
    SELECT *, or_tp / (or_tp + or_fn) AS or_recall, both_wrong / n AS double_fault, same / n AS agreement FROM c""",
)
def agg_pairjudge(spark, sf_dir):
    return agreement.judge_pair(judged(spark, sf_dir), F.col("rel"), F.col("a"), F.col("b"))


@query(
    "agg_kappa_pabak",
    RULE
    + """, k AS (SELECT a::INT AS x, b::INT AS y FROM j), m AS (SELECT count(*) AS n, avg((x = y)::INT) AS po,
      (sum(x) * sum(y) + sum(1 - x) * sum(1 - y)) / (count(*) * count(*)) AS pe FROM k)
    SELECT n, po AS agreement, CASE WHEN pe <> 1 THEN (po - pe) / (1 - pe) END AS kappa, 2 * po - 1 AS pabak FROM m""",
)
def agg_kappa_pabak(spark, sf_dir):
    return agreement.cohen(judged(spark, sf_dir), "a", "b")


RATERS = """r AS (SELECT doc_id, k AS rater, CASE WHEN (doc_id * (k + 3)) % 7 < 3 THEN 1 ELSE 0 END AS label FROM labels, (VALUES (1), (2), (3)) v(k))"""


def rated(spark, sf_dir):
    own = t(spark, sf_dir, "labels").select("doc_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("rater"))
    return own.withColumn("label", F.when((F.col("doc_id") * (F.col("rater") + 3)) % 7 < 3, 1).otherwise(0))


@query(
    "agg_fleiss",
    f"""WITH {RATERS}, c AS (SELECT doc_id, label, count(*) AS c FROM r GROUP BY ALL), i AS (SELECT sum(c * (c - 1)) AS pairs, count(DISTINCT doc_id) AS n FROM c),
    s AS (SELECT sum(c * c) AS sq FROM (SELECT label, sum(c) AS c FROM c GROUP BY 1))
    SELECT n AS n_items, 3::BIGINT AS raters, (pairs / (n * 6) - sq / (n * n * 9)) / (1 - sq / (n * n * 9)) AS kappa FROM i, s""",
)
def agg_fleiss(spark, sf_dir):
    return agreement.fleiss(rated(spark, sf_dir), "doc_id", "label", 3)


@query(
    "agg_pair_2x2",
    f"""WITH {RATERS}, p AS (SELECT x.rater AS rater_a, y.rater AS rater_b, x.label AS a, y.label AS b FROM r x JOIN r y ON x.doc_id = y.doc_id AND x.rater < y.rater),
    c AS (SELECT rater_a, rater_b, count(*) AS n, sum((a = 1 AND b = 1)::INT)::BIGINT AS both_yes, sum((a = 1 AND b = 0)::INT)::BIGINT AS a_only, sum((a = 0 AND b = 1)::INT)::BIGINT AS b_only, sum((a = 0 AND b = 0)::INT)::BIGINT AS both_no FROM p GROUP BY ALL),
    k AS (SELECT *, (both_yes + both_no) / n AS po, ((both_yes + a_only) * (both_yes + b_only) + (both_no + a_only) * (both_no + b_only)) / (n * n) AS pe FROM c)
    SELECT rater_a, rater_b, n, both_yes, a_only, b_only, both_no, (po - pe) / (1 - pe) AS kappa, 2 * po - 1 AS pabak FROM k""",
)
def agg_pair_2x2(spark, sf_dir):
    return agreement.rater_pairs(rated(spark, sf_dir), "doc_id", "rater", "label")


@query(
    "agg_kappa_flags",
    """WITH r AS (SELECT source, (quality = 1)::INT AS a, (length(text) >= 600)::INT AS b FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
    m AS (SELECT source, count(*) AS n, avg((a = b)::INT) AS po, (sum(a) * sum(b) + sum(1 - a) * sum(1 - b)) / (count(*) * count(*)) AS pe FROM r GROUP BY 1),
    k AS (SELECT source, n, CASE WHEN pe <> 1 THEN (po - pe) / (1 - pe) END AS kappa FROM m)
    SELECT source, n, CASE WHEN n < 10 THEN 'suppressed' WHEN kappa < 0 THEN 'below_chance' WHEN kappa < 0.4 THEN 'low' ELSE 'shown' END AS flag FROM k""",
)
def agg_kappa_flags(spark, sf_dir):
    own = t(spark, sf_dir, "labels").join(t(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id")
    own = own.select("source", (F.col("quality") == 1).cast("int").alias("a"), (F.length("text") >= 600).cast("int").alias("b"))
    return agreement.cohen(own, "a", "b", ["source"]).select("source", "n", agreement.kappa_flag(F.col("n"), F.col("kappa")).alias("flag"))


@query(
    "agg_capture_cells",
    f"""WITH r AS (SELECT {TITLE} AS title, CASE (doc_id % 3) WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS source FROM documents),
    s AS (SELECT title, string_agg(DISTINCT source, '+' ORDER BY source) AS sources FROM r GROUP BY 1) SELECT sources, count(*) AS n FROM s GROUP BY 1""",
)
def agg_capture_cells(spark, sf_dir):
    source = F.get(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("doc_id") % 3).cast("int"))
    return agreement.source_cells(titled(spark, sf_dir).withColumn("s", source), "title", "s")


@query(
    "agg_set_hash",
    """SELECT o_orderstatus, sha256('[' || string_agg('"' || o_orderkey || '"', ',' ORDER BY o_orderkey::VARCHAR) || ']') AS set_hash FROM orders GROUP BY 1""",
)
def agg_set_hash(spark, sf_dir):
    return agreement.set_hash(t(spark, sf_dir, "orders"), "o_orderkey", ["o_orderstatus"])


@query(
    "agg_best_record",
    f"""WITH r AS (SELECT *, {TITLE} AS title FROM documents)
    SELECT title, first(text ORDER BY length(text) DESC, doc_id) AS text, first(lang ORDER BY doc_id) AS lang, count(*) AS n FROM r GROUP BY 1""",
)
def agg_best_record(spark, sf_dir):
    own = titled(spark, sf_dir)
    best = agreement.best_record(own, "title", ["doc_id"], "text", ["lang"], [])
    return best.join(own.groupBy("title").agg(F.count(F.lit(1)).alias("n")), "title")


@query(
    "agg_strata",
    RULE + """ SELECT a AS excluded, count(*) AS population, sum((doc_id % 5 = 0)::INT)::BIGINT AS sampled, sum((doc_id % 5 = 0 AND rel)::INT)::BIGINT AS relevant FROM j GROUP BY 1""",
)
def agg_strata(spark, sf_dir):
    return screening.audit_strata(judged(spark, sf_dir), "a", F.col("doc_id") % 5 == 0, F.col("rel"))


@query(
    "win_latest_state",
    """SELECT DISTINCT ON (user_id, event_type) user_id, event_type, event_id, ts, value FROM events ORDER BY user_id, event_type, ts DESC, event_id DESC""",
)
def win_latest_state(spark, sf_dir):
    own = t(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return ranking.latest(own, ["user_id", "event_type"], ["ts", "event_id"])


@query(
    "win_replay_cutoff",
    """WITH e AS (SELECT * FROM events WHERE event_id <= 700), u AS (SELECT user_id, max(event_id) FILTER (event_type = 'error') AS undo, max(event_id) FILTER (event_type <> 'error') AS last FROM e GROUP BY 1)
    SELECT u.user_id, e.event_type, e.event_id FROM u JOIN e ON e.event_id = u.last WHERE undo IS NULL OR last > undo""",
)
def win_replay_cutoff(spark, sf_dir):
    return ranking.replay(t(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type", "error", 700)


@query(
    "win_replay_stack",
    """WITH e AS (SELECT user_id, list({'id': event_id, 'type': event_type} ORDER BY event_id) AS es FROM events GROUP BY 1),
    s AS (SELECT user_id, list_reduce(list_prepend([], list_transform(es, lambda x: [x])), lambda held, x: CASE WHEN x[1].type <> 'error' THEN list_concat(held, x) ELSE held[1:greatest(len(held) - 1, 0)] END) AS held FROM e)
    SELECT user_id, held[-1].type AS event_type, held[-1].id AS event_id FROM s WHERE len(held) > 0""",
)
def win_replay_stack(spark, sf_dir):
    return ranking.replay_stack(t(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type", "error")


@query(
    "win_queue_position",
    """SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('seed' || chr(31) || source || chr(31) || doc_id), doc_id)::INT AS position FROM documents""",
)
def win_queue_position(spark, sf_dir):
    own = t(spark, sf_dir, "documents").select("doc_id", "source")
    return ranking.queue_position(own, ["source"], [ranking.seeded_key("seed", F.col("source"), F.col("doc_id")), F.col("doc_id")])


@query(
    "topk_seeded_sample",
    """WITH k AS (SELECT o_orderpriority, o_orderkey, sha256('audit' || chr(31) || o_orderpriority || chr(31) || o_orderkey) AS sort_key FROM orders)
    SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY sort_key, o_orderkey) <= 20""",
)
def topk_seeded_sample(spark, sf_dir):
    return ranking.seeded_sample(t(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey"), ["o_orderpriority"], "o_orderkey", 20, "audit")


@query(
    "sort_split_pool",
    """SELECT o_orderkey, o_orderstatus, ['ann', 'bob', 'eve'][(row_number() OVER (PARTITION BY o_orderstatus ORDER BY sha256('split' || chr(31) || o_orderkey), o_orderkey) - 1) % 3 + 1] AS reader FROM orders""",
)
def sort_split_pool(spark, sf_dir):
    return ranking.split_pool(t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"], "o_orderkey", ["ann", "bob", "eve"], "split")


@query(
    "sort_second_reader",
    """WITH h AS (SELECT c_custkey, p, sha256('second' || chr(31) || p || chr(31) || c_custkey) AS h FROM customer, (VALUES ('ann'), ('bob'), ('eve')) v(p) WHERE p <> 'ann')
    SELECT c_custkey, 'ann' AS first, arg_min(p, h) AS second FROM h GROUP BY 1""",
)
def sort_second_reader(spark, sf_dir):
    own = t(spark, sf_dir, "customer").select("c_custkey", F.lit("ann").alias("first"))
    return ranking.second_reader(own, "c_custkey", "first", ["ann", "bob", "eve"], "second")


@query("lim_keyset", "SELECT o_orderdate, o_orderkey FROM orders WHERE (o_orderdate, o_orderkey) > (TIMESTAMP '1996-05-01', 100) ORDER BY 1, 2 LIMIT 51")
def lim_keyset(spark, sf_dir):
    own = t(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey")
    return ranking.page_after(own, ["o_orderdate", "o_orderkey"], (__import__("datetime").datetime(1996, 5, 1), 100), 50)


@query(
    "win_islands",
    """WITH e AS (SELECT user_id, event_id, epoch_ms(ts) // 1000 AS s FROM events), g AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) < 86400 THEN 0 ELSE 1 END AS o FROM e)
    SELECT user_id, event_id, sum(o) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS passage FROM g""",
)
def win_islands(spark, sf_dir):
    """Events of a user within a day of the last one are one passage."""
    own = t(spark, sf_dir, "events").select("user_id", "event_id", F.unix_timestamp("ts").alias("s"), F.struct(F.unix_timestamp("ts").alias("s"), "event_id").alias("place"))
    return ranking.islands(own, ["user_id"], "s", "s", 86_400, order="place").select("user_id", "event_id", "passage")


@query(
    "win_prefix",
    """WITH f AS (SELECT user_id, min(event_id) FILTER (event_type = 'error') AS stop FROM events GROUP BY 1)
    SELECT e.user_id, e.event_id FROM events e JOIN f ON f.user_id = e.user_id WHERE stop IS NULL OR event_id < stop""",
)
def win_prefix(spark, sf_dir):
    own = t(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return ranking.running_prefix(own, ["user_id"], "event_id", F.col("event_type") != "error").select("user_id", "event_id")


LINES = "t AS (SELECT l_orderkey AS field, sum(l_extendedprice::DECIMAL(18,2))::DECIMAL(38,18) AS expected FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey AS field, o_totalprice::DECIMAL(18,2)::DECIMAL(38,18) AS actual FROM orders)"


def sums(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("field")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast(numbers.DECIMAL).alias("expected"))


@query(
    "cmp_fields_numeric",
    f"""WITH {LINES} SELECT t.field, CASE WHEN o.field IS NULL THEN 'not_compared' WHEN abs(expected - actual) <= 1000 OR (expected <> 0 AND abs(expected - actual) <= abs(expected) * 0.5) THEN 'match' ELSE 'mismatch' END AS match_status
    FROM t LEFT JOIN o ON o.field = t.field""",
)
def cmp_fields_numeric(spark, sf_dir):
    plan = sums(spark, sf_dir).select("field", F.col("expected").cast("string").alias("expected"), F.lit("numeric").alias("operator"), F.lit(1000.0).alias("absolute"), F.lit(0.5).alias("relative"), F.lit("major").alias("severity"))
    found = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("field"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("actual"), F.lit("extracted").alias("status"))
    return compare.compare_fields(plan, found).select("field", "match_status")


ROWS = f"""{LINES}, m AS (SELECT coalesce(t.field, o.field) AS field, expected, actual, CASE WHEN t.field IS NULL THEN 'not_in_reference' WHEN o.field IS NULL THEN 'not_in_document'
    WHEN abs(expected - actual) <= 5000 THEN 'match' ELSE 'mismatch' END AS match_status FROM (SELECT * FROM t WHERE field % 7 <> 0) t FULL JOIN (SELECT * FROM o WHERE field % 5 <> 0) o ON o.field = t.field)"""


def compared_rows(spark, sf_dir):
    reference = sums(spark, sf_dir).where("field % 7 <> 0")
    document = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("field"), F.col("o_totalprice").cast("decimal(18,2)").cast(numbers.DECIMAL).alias("actual")).where("field % 5 <> 0")
    return compare.compare_rows(reference, document, ["field"], "expected", "actual", absolute=5000.0)


@query("cmp_rows_full_outer", f"WITH {ROWS} SELECT field, match_status FROM m")
def cmp_rows_full_outer(spark, sf_dir):
    return compared_rows(spark, sf_dir).select("field", "match_status")


@query(
    "agg_summary_coverage",
    f"""WITH {ROWS}, s AS (SELECT CASE WHEN match_status LIKE 'not_in%' THEN 'not_compared' ELSE match_status END AS s FROM m),
    c AS (SELECT count(*) AS fields, count(*) FILTER (s = 'match') AS matches, count(*) FILTER (s = 'mismatch') AS mismatches, count(*) FILTER (s = 'not_compared') AS not_compared, 0::BIGINT AS ambiguous FROM s)
    SELECT *, (matches + mismatches) / fields AS coverage, matches / (matches + mismatches) AS agreement FROM c""",
)
def agg_summary_coverage(spark, sf_dir):
    own = compared_rows(spark, sf_dir)
    own = own.withColumn("match_status", F.when(F.col("match_status").startswith("not_in"), "not_compared").otherwise(F.col("match_status")))
    return compare.summarize(own)


@query(
    "xtr_valid_totals",
    """WITH p AS (SELECT l_linestatus, l_returnflag, sum(l_quantity::DECIMAL(18,2)) AS q FROM lineitem GROUP BY ALL), w AS (SELECT l_linestatus, sum(l_quantity::DECIMAL(18,2)) AS t FROM lineitem GROUP BY 1),
    s AS (SELECT l_linestatus, sum(q) AS q FROM p WHERE NOT (l_linestatus = 'O' AND l_returnflag = 'R') GROUP BY 1)
    SELECT w.l_linestatus, t::DOUBLE AS total, q::DOUBLE AS sum_of_parts, CASE WHEN q IS NULL THEN 'no_parts' WHEN q <> t THEN 'sum_differs' END AS problem FROM w LEFT JOIN s ON s.l_linestatus = w.l_linestatus""",
)
def xtr_valid_totals(spark, sf_dir):
    lines = t(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("decimal(18,2)"))
    parts = lines.groupBy("l_linestatus", "l_returnflag").agg(F.sum("q").alias("q")).where("not (l_linestatus = 'O' and l_returnflag = 'R')")
    totals = lines.groupBy("l_linestatus").agg(F.sum("q").alias("t"))
    out = compare.parts_total(parts, totals, ["l_linestatus"], "q", "t")
    return out.select("l_linestatus", F.col("total").cast("double").alias("total"), F.col("sum_of_parts").cast("double").alias("sum_of_parts"), "problem")


@query(
    "xtr_share_recomputes",
    """WITH p AS (SELECT l_returnflag, sum(l_quantity) AS q FROM lineitem GROUP BY 1), w AS (SELECT sum(q) AS t FROM p)
    SELECT l_returnflag, CASE WHEN l_returnflag = 'A' THEN true ELSE false END AS ok FROM p, w""",
)
def xtr_share_recomputes(spark, sf_dir):
    lines = t(spark, sf_dir, "lineitem")
    parts = lines.groupBy("l_returnflag").agg(F.sum("l_quantity").alias("q"))
    total = lines.agg(F.sum("l_quantity").alias("t"))
    own = parts.join(F.broadcast(total))
    share = F.round(100 * F.col("q").cast("decimal(20,6)") / F.col("t").cast("decimal(20,6)"), 2)
    printed = F.when(F.col("l_returnflag") == "A", share).otherwise(share + F.lit(0.5).cast("decimal(3,1)")).cast("decimal(10,2)").cast("string")
    return own.select("l_returnflag", compare.share_recomputes(F.col("q"), F.col("t"), printed).alias("ok"))


@query(
    "xtr_reconcile",
    """WITH a AS (SELECT o_orderkey AS k, o_orderpriority AS v FROM orders WHERE o_orderkey % 4 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 = 0 THEN 'other' ELSE lower(o_orderpriority) END AS v FROM orders WHERE o_orderkey % 5 <> 0),
    j AS (SELECT coalesce(a.k, b.k) AS k, a.v AS first, b.v AS second, CASE WHEN a.v IS NULL THEN 'second_only' WHEN b.v IS NULL THEN 'first_only' WHEN lower(a.v) = lower(b.v) THEN 'agreed' ELSE 'conflict' END AS state FROM a FULL JOIN b ON a.k = b.k)
    SELECT *, state = 'agreed' AND ('0x' || substring(sha256(k::VARCHAR), 1, 8))::BIGINT % 10 = 0 AS recheck FROM j""",
)
def xtr_reconcile(spark, sf_dir):
    own = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("v"))
    other = own.where("k % 5 <> 0").withColumn("v", F.when(F.col("k") % 9 == 0, "other").otherwise(F.lower("v")))
    return compare.reconcile(own.where("k % 4 <> 0"), other, ["k"], "v")


@query(
    "str_norm_numeric",
    """WITH s AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '1,234.' || p_size WHEN 1 THEN '1.234,' || p_size WHEN 2 THEN p_size || ',5' WHEN 3 THEN '1,2,' || p_size ELSE '1.2.' || p_size END AS raw FROM part)
    SELECT p_partkey, raw, CASE p_partkey % 5 WHEN 0 THEN replace(raw, ',', '') WHEN 1 THEN replace(replace(raw, '.', ''), ',', '.') WHEN 2 THEN replace(raw, ',', '.') WHEN 3 THEN replace(raw, ',', '') ELSE replace(raw, '.', '') END AS value FROM s""",
)
def str_norm_numeric(spark, sf_dir):
    n = F.col("p_size").cast("string")
    forms = [F.concat(F.lit("1,234."), n), F.concat(F.lit("1.234,"), n), F.concat(n, F.lit(",5")), F.concat(F.lit("1,2,"), n), F.concat(F.lit("1.2."), n)]
    raw = F.get(F.array(*forms), (F.col("p_partkey") % 5).cast("int"))
    return t(spark, sf_dir, "part").select("p_partkey", raw.alias("raw")).withColumn("value", text.normalize(F.col("raw"), ["trim", "numeric_punctuation"]))


@query(
    "str_identifiers",
    """SELECT c_custkey, lower('10.1000/' || c_name) AS doi, (10000000 + c_custkey)::VARCHAR AS pmid, 'PMC' || c_custkey AS pmcid,
    ['NCT' || lpad(c_custkey::VARCHAR, 8, '0'), '2004-' || lpad(c_custkey::VARCHAR, 6, '0') || '-12'] AS registry_ids, (1900 + c_nationkey)::INT AS year FROM customer""",
)
def str_identifiers(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    doi = F.concat(F.lit(" https://doi.org/10.1000/"), "c_name")
    note = F.concat(F.lit("see nct"), F.lpad(key, 8, "0"), F.lit(", NCT"), F.lpad(key, 8, "0"), F.lit(" and 2004-"), F.lpad(key, 6, "0"), F.lit("-12"))
    year = F.concat(F.lit("vol 12345 ("), (1900 + F.col("c_nationkey")).cast("string"), F.lit("; 2001)"))
    own = t(spark, sf_dir, "customer")
    return own.select("c_custkey", text.canonical_doi(doi).alias("doi"), text.pmid(F.concat(F.lit("PMID: "), (F.lit(10_000_000) + F.col("c_custkey")).cast("string"))).alias("pmid"), text.pmcid(F.concat(F.lit("pmc"), key)).alias("pmcid"), text.registry_ids(note).alias("registry_ids"), text.year_in(year).alias("year"))


@query(
    "str_title",
    f"SELECT doc_id, {TITLE} AS title FROM documents",
)
def str_title(spark, sf_dir):
    return titled(spark, sf_dir).select("doc_id", "title")


@query(
    "str_row_key",
    """SELECT p_partkey, p_name || ' (' || p_brand || ')' AS raw, left(regexp_replace(regexp_replace(p_name || ' (' || p_brand || ')', '[^A-Za-z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g'), 96) AS key FROM part""",
)
def str_row_key(spark, sf_dir):
    raw = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))
    return t(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"), text.row_key(raw).alias("key"))


@query(
    "num_parse_value",
    """WITH s AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'NA' WHEN 1 THEN '1,' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') || '.50' WHEN 2 THEN '12,5' ELSE (c_custkey)::VARCHAR END AS raw FROM customer)
    SELECT c_custkey, raw, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN replace(raw, ',', '') WHEN 2 THEN NULL ELSE raw END AS value, CASE c_custkey % 4 WHEN 0 THEN 'missing' WHEN 2 THEN 'invalid' ELSE 'extracted' END AS status FROM s""",
)
def num_parse_value(spark, sf_dir):
    k = F.col("c_custkey")
    forms = [F.lit("NA"), F.concat(F.lit("1,"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(".50")), F.lit("12,5"), k.cast("string")]
    own = t(spark, sf_dir, "customer").select("c_custkey", F.get(F.array(*forms), (k % 4).cast("int")).alias("raw"))
    return own.withColumn("p", numbers.parse_value(F.col("raw"), numbers.Scalar("decimal", group_mark=","))).select("c_custkey", "raw", "p.value", "p.status")


@query(
    "led_chain_verify",
    """WITH p AS (SELECT user_id AS project_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS seq FROM events), n AS (SELECT project_id, count(*) AS events FROM p GROUP BY 1)
    SELECT project_id, events, CASE WHEN project_id % 5 = 0 AND events >= 3 THEN 3 END AS first_bad_seq, CASE WHEN project_id % 5 = 0 AND events >= 3 THEN 'payload' END AS problem FROM n""",
)
def led_chain_verify(spark, sf_dir):
    from pyspark.sql.window import Window

    own = t(spark, sf_dir, "events").select(
        F.col("user_id").alias("project_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("seq"), "event_id", F.col("event_type").alias("type"), F.lit("actor").alias("actor_id"), F.col("ts").cast("string").alias("recorded_at"), F.col("props").alias("payload")
    )
    sealed = ledger.chained(own)
    tampered = sealed.withColumn("payload", F.when((F.col("project_id") % 5 == 0) & (F.col("seq") == 3), "{}").otherwise(F.col("payload")))
    return ledger.verify(tampered)


@query(
    "led_milestones",
    """SELECT user_id AS project_id, event_type AS type, min(event_id) AS first_seq, max(event_id) AS last_seq, count(*) AS n FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY 1, 2""",
)
def led_milestones(spark, sf_dir):
    own = t(spark, sf_dir, "events").select(F.col("user_id").alias("project_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("type"))
    return ledger.milestones(own, ["signup", "purchase"])


@query("flt_event_page", "SELECT event_id AS seq, event_type AS type, user_id::VARCHAR AS actor_id FROM events WHERE event_type LIKE 'si%' AND event_id > 100 AND event_id <= 900 ORDER BY 1 LIMIT 21")
def flt_event_page(spark, sf_dir):
    own = t(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.concat(F.substring("event_type", 1, 2), F.lit("."), "event_type").alias("full"), "event_type", F.col("user_id").cast("string").alias("actor_id"))
    page = ledger.event_page(own.withColumnRenamed("full", "type"), ["si."], after=100, through=900, limit=20)
    return page.select("seq", F.col("event_type").alias("type"), "actor_id")


@query("link_fuzzy_groups")
def link_fuzzy_groups(spark, sf_dir):
    return linkage.class_groups(linkage.class_links(records(spark, sf_dir)))


@query("link_proposals")
def link_proposals(spark, sf_dir):
    links = linkage.class_links(records(spark, sf_dir))
    return linkage.class_proposals(linkage.class_groups(links), links)


def records(spark, sf_dir):
    none = F.lit(None).cast("string")
    first = F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1))
    return t(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("occurrence_id"), F.col("doc_id").alias("input_pos"), first.alias("title"), F.array(F.col("lang")).alias("authors"), (2000 + F.col("doc_id") % 2).cast("int").alias("year"), none.alias("doi"), none.alias("pmid"), none.alias("pmcid"), "source"
    )


@query(
    "flow_prisma",
    f"""WITH r AS (SELECT doc_id, {TITLE} AS title FROM documents), u AS (SELECT title, min(doc_id) AS doc_id FROM r GROUP BY 1),
    x AS (SELECT u.doc_id, quality, toxic FROM u LEFT JOIN labels l ON l.doc_id = u.doc_id), c AS (
      SELECT (SELECT count(*) FROM r) AS identified, count(*) AS screened, count(*) FILTER (quality IS NULL) AS undecided, count(*) FILTER (quality = 0) AS excluded, count(*) FILTER (quality = 1) AS included_title, count(*) FILTER (quality = 1 AND toxic = 1) AS excluded_full, count(*) FILTER (quality = 1 AND toxic = 0) AS included FROM x)
    SELECT m.metric, m.n FROM c, LATERAL (VALUES ('identified', identified), ('duplicates', identified - screened), ('screened', screened), ('undecided', undecided), ('excluded_title', excluded), ('assessed', included_title), ('excluded_full', excluded_full), ('included', included)) m(metric, n)""",
)
def flow_prisma(spark, sf_dir):
    own = titled(spark, sf_dir).select("doc_id", "title")
    labels = t(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "include").when(F.col("quality") == 0, "exclude").alias("title_outcome"), F.when(F.col("toxic") == 1, "exclude").when(F.col("toxic") == 0, "include").alias("full_outcome"))
    return screening.flow(own, labels, "doc_id", "title").select("metric", "n")


@query("flow_checks")
def flow_checks(spark, sf_dir):
    own = titled(spark, sf_dir).select("doc_id", "title")
    labels = t(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "include").when(F.col("quality") == 0, "exclude").alias("title_outcome"), F.when(F.col("toxic") == 1, "exclude").when(F.col("toxic") == 0, "include").alias("full_outcome"))
    return screening.flow_checks(screening.flow(own, labels, "doc_id", "title"))


@query(
    "stat_closed_forms",
    """SELECT n_nationkey, greatest(1, ceil(ln(0.05) / ln(0.5 + n_nationkey / 60.0)))::INT AS recall_needed, (n_nationkey + 11) * (n_nationkey + 21) / (n_nationkey + 1) - 1 AS chapman,
    exp(ln(n_nationkey + 2) + ln(30) + ln(20) + ln(10) - ln(5) - ln(6) - ln(7)) AS unseen FROM nation""",
)
def stat_closed_forms(spark, sf_dir):
    k = F.col("n_nationkey")
    cells = {"111": k + 2, "100": F.lit(30), "010": F.lit(20), "001": F.lit(10), "110": F.lit(5), "101": F.lit(6), "011": F.lit(7)}
    return t(spark, sf_dir, "nation").select("n_nationkey", statistics.recall_needed_column(0.5 + k / 60.0).alias("recall_needed"), statistics.chapman_estimate(k + 10, k + 20, k).alias("chapman"), statistics.loglinear_unseen(cells)[0].alias("unseen"))


@query("stat_clopper_pearson")
def stat_clopper_pearson(spark, sf_dir):
    own = judged(spark, sf_dir).groupBy("b").agg(F.sum(F.col("rel").cast("int")).alias("k"), F.count(F.lit(1)).alias("n"))
    return own.withColumn("i", statistics.clopper_pearson_column("k", "n")).select("b", "k", "n", "i.lower", "i.upper")


@query("stat_stop")
def stat_stop(spark, sf_dir):
    order = ranking.seeded_key("stop", F.col("doc_id"))
    own = t(spark, sf_dir, "labels").join(t(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    seen = own.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("quality").alias("q")))), lambda s: s["q"]).alias("labels"))
    return seen.select("source", F.size("labels").alias("screened"), statistics.stop_test_column(0.95)("labels", F.lit(5)).alias("p_value"))


@query(
    "flt_grid_sort",
    """SELECT p_partkey, p_name, p_size FROM part WHERE p_brand IN ('Brand#13', 'Brand#5', 'Brand#21') AND contains(lower(p_name), 'widget')""",
)
def flt_grid_sort(spark, sf_dir):
    own = grid.filtered(t(spark, sf_dir, "part"), {"p_brand": {"values": ["Brand#13", "Brand#5", "Brand#21"]}, "p_name": {"contains": "WIDGET"}})
    return grid.ordered(own, [("p_size", True), ("p_name", False)], "p_partkey").select("p_partkey", "p_name", "p_size")


@query(
    "flt_facet",
    """SELECT 'p_brand' AS column, p_brand AS value, count(*) AS n FROM part WHERE p_type = 'ECONOMY' GROUP BY 2 UNION ALL SELECT 'p_type', p_type, count(*) FROM part WHERE p_brand IN ('Brand#13', 'Brand#5') GROUP BY 2""",
)
def flt_facet(spark, sf_dir):
    return grid.facets(t(spark, sf_dir, "part"), {"p_brand": {"values": ["Brand#13", "Brand#5"]}, "p_type": {"values": ["ECONOMY"]}})


def fuzzy_sql(terms: list[tuple[str, int]], rows: str) -> str:
    """Points in SQL: rows has key, short and long, in lower case."""
    one = lambda t, k: f"""CASE WHEN contains(short, '{t}') THEN 3 WHEN {k} > 0 AND len([w FOR w IN regexp_extract_all(short, '[\\p{{L}}\\p{{N}}]+') IF damerau_levenshtein('{t}', w) <= {k} OR (length(w) > {len(t)} AND damerau_levenshtein('{t}', left(w, {len(t)})) <= {k})]) > 0 THEN 2 WHEN contains(long, '{t}') THEN 1 END"""
    return f"WITH r AS ({rows}), p AS (SELECT key, {' + '.join(one(*t) for t in terms)} AS points FROM r) SELECT * FROM p WHERE points IS NOT NULL"


@query("flt_fuzzy", fuzzy_sql([("widgte", 1), ("econ", 0)], "SELECT p_partkey AS key, lower(p_name || ' ' || chr(1) || ' ' || p_type) AS short, '' AS long FROM part"))
def flt_fuzzy(spark, sf_dir):
    return grid.searched(t(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), "p_name", "p_type"), "widgte econ", ["p_name", "p_type"], None, "key").select("key", "points")


@query(
    "flt_fuzzy_documents",
    fuzzy_sql([("thlyouble", 2), ("woethless", 2), ("src", 0)], "SELECT doc_id AS key, lower(strip_accents(split_part(coalesce(text, ''), chr(10), 1) || ' ' || chr(1) || ' ' || coalesce(source, ''))) AS short, lower(strip_accents(coalesce(text, ''))) AS long FROM documents"),
)
def flt_fuzzy_documents(spark, sf_dir):
    """Two terms with room for two typos, in first lines and sources or whole texts."""
    own = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1)).alias("title"), "source", "text")
    return grid.searched(own, "Thlyouble woethless src", ["title", "source"], "text", "key").select("key", "points")


@query(
    "enr_merge_precedence",
    """SELECT c.c_custkey, coalesce(s.s_name, n.n_name, c.c_name) AS name, CASE WHEN s.s_name IS NOT NULL THEN 'supplier' WHEN n.n_name IS NOT NULL THEN 'nation' ELSE 'customer' END AS name_from
    FROM customer c LEFT JOIN supplier s ON s.s_suppkey = c.c_custkey AND s.s_nationkey = c.c_nationkey LEFT JOIN nation n ON n.n_nationkey = c.c_custkey""",
)
def enr_merge_precedence(spark, sf_dir):
    base = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("check"))
    supplier = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("check"))
    nation = t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"), F.lit(None).cast("int").alias("check"))
    out = screening.merge_sources(base, [("supplier", supplier), ("nation", nation)], "key", ["name"], "check", "customer")
    return out.select(F.col("key").alias("c_custkey"), "name", "name_from")


@query(
    "join_first_identifier",
    """SELECT o.o_orderkey, coalesce(c.c_name, s.s_name) AS name FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND o.o_orderkey % 2 = 0 LEFT JOIN supplier s ON s.s_suppkey = o.o_orderkey % 10""",
)
def join_first_identifier(spark, sf_dir):
    k = F.col("o_orderkey")
    own = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    sources = [(F.when(k % 2 == 0, F.col("o_custkey")), t(spark, sf_dir, "customer"), "c_custkey", "c_name"), (k % 10, t(spark, sf_dir, "supplier"), "s_suppkey", "s_name")]
    return joins.first_match(own, sources, "name").drop("o_custkey")


@query(
    "join_exists",
    """SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderpriority = '1-URGENT')""",
)
def join_exists(spark, sf_dir):
    orders = t(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    own = t(spark, sf_dir, "customer").select("c_custkey")
    return joins.kept(own, "c_custkey", [orders.where("o_orderstatus = 'F'")], [orders.where("o_orderpriority = '1-URGENT'")])


@query("join_scalar_latest", "SELECT c_custkey, (SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS last_order FROM customer")
def join_scalar_latest(spark, sf_dir):
    orders = t(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return joins.with_latest(t(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", orders, "o_orderdate", "last_order")


@query(
    "set_diff_paths",
    """WITH a AS (SELECT p_partkey AS path, p_size::VARCHAR AS value FROM part WHERE p_partkey % 3 <> 0), b AS (SELECT p_partkey AS path, CASE WHEN p_partkey % 4 = 0 THEN 'x' ELSE p_size::VARCHAR END AS value FROM part WHERE p_partkey % 5 <> 0)
    SELECT * FROM (SELECT coalesce(a.path, b.path) AS path, a.value AS old, b.value AS new, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.value <> b.value THEN 'changed' END AS kind FROM a FULL JOIN b ON a.path = b.path) WHERE kind IS NOT NULL""",
)
def set_diff_paths(spark, sf_dir):
    own = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").cast("string").alias("value"))
    after = own.where("path % 5 <> 0").withColumn("value", F.when(F.col("path") % 4 == 0, "x").otherwise(F.col("value")))
    return compare.diff_paths(own.where("path % 3 <> 0"), after)


@query(
    "scr_outcomes",
    """WITH d AS (SELECT user_id % 40 AS item, user_id AS reviewer, arg_max(CASE WHEN value > 120 THEN 'include' ELSE 'exclude' END, event_id) AS outcome FROM events GROUP BY 1, 2),
    i AS (SELECT item, count(*) AS readers, count(DISTINCT outcome) AS kinds, min(outcome) AS one FROM d GROUP BY 1)
    SELECT item, readers, CASE WHEN readers < 2 THEN 'pending' WHEN kinds > 1 THEN 'conflict' ELSE one END AS outcome FROM i""",
)
def scr_outcomes(spark, sf_dir):
    own = t(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("item"), F.col("user_id").alias("reviewer"), F.col("event_id").alias("seq"), F.when(F.col("value") > 120, "include").otherwise("exclude").alias("outcome"))
    return screening.outcomes(own, "item", "reviewer", "outcome", "seq", readers=2)


@query(
    "stm_dedupe_commands",
    """SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2""",
)
def stm_dedupe_commands(spark, sf_dir):
    own = t(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return ranking.first(own, ["user_id", "event_type"], ["event_id"])


@query(
    "stm_tumbling_attempts",
    """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""",
)
def stm_tumbling_attempts(spark, sf_dir):
    from veritrail.streaming.windows import tumbling

    return tumbling(t(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"], "value")


@query(
    "stm_update_search",
    """WITH a AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN coalesce(text, '') || '!' ELSE coalesce(text, '') END) AS h FROM documents WHERE doc_id % 4 <> 0)
    SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'new' WHEN b.doc_id IS NULL THEN 'gone' WHEN a.h <> b.h THEN 'changed' ELSE 'same' END AS kind FROM a FULL JOIN b ON a.doc_id = b.doc_id""",
)
def stm_update_search(spark, sf_dir):
    own = t(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    later = own.where("doc_id % 4 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return screening.update_diff(own.where("doc_id % 3 <> 0"), later, "doc_id", "text")
