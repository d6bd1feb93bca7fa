"""Queries of extraction by locators, over the customers of nations as tables; their SQL computes the answer on its own."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrail.operators import located
from veritrail.plans.catalog import t
from veritrail.plans.registry import query

s = lambda c: F.col(c).cast("string")
#: Printed balances and keys: keys aren't reported, or can't be read, for some customers.
PRINTED = """c AS (SELECT *, (c_acctbal * 100)::BIGINT AS cents, CASE WHEN c_custkey % 11 = 0 THEN 'NR' WHEN c_custkey % 13 = 0 THEN 'about ' || c_custkey ELSE c_custkey::VARCHAR END AS key_text FROM customer),
    p AS (SELECT *, CASE WHEN cents < 0 THEN '-' ELSE '' END || abs(cents) // 100 || '.' || lpad((abs(cents) % 100)::VARCHAR, 2, '0') AS balance FROM c)"""


def printed(spark, sf_dir):
    cents = (F.col("c_acctbal").cast("decimal(20,2)") * 100).cast("long")
    balance = F.concat(F.when(cents < 0, "-").otherwise(""), F.floor(F.abs(cents) / 100).cast("string"), F.lit("."), F.lpad((F.abs(cents) % 100).cast("string"), 2, "0"))
    k = F.col("c_custkey")
    return t(spark, sf_dir, "customer").withColumns({"balance": balance, "key_text": F.when(k % 11 == 0, "NR").when(k % 13 == 0, F.concat(F.lit("about "), s("c_custkey"))).otherwise(s("c_custkey"))})


def laid_out(spark, sf_dir):
    """A table a nation: two header rows, a group row for each market segment, a row for each customer."""
    own = printed(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_mktsegment", "kind", "c_custkey")) + 1
    groups = own.select("c_nationkey", "c_mktsegment").distinct().select("c_nationkey", "c_mktsegment", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("c_custkey"), F.array(F.col("c_mktsegment"), F.lit(""), F.lit(" ")).alias("texts"))
    rows = groups.union(own.select("c_nationkey", "c_mktsegment", F.lit(1), F.col("c_custkey").cast("long"), F.array("c_name", F.concat(F.lit("USD "), "balance"), "key_text"))).withColumn("row", place)
    body = rows.select("c_nationkey", "row", "texts", F.lit(False).alias("header"), F.array(F.array().cast("array<string>"), F.array(F.lit("Balance"), F.lit("in USD")), F.array().cast("array<string>")).alias("paths"))
    head = own.select("c_nationkey").distinct().select("c_nationkey", F.explode(F.array(F.struct(F.lit(0).alias("row"), F.array(F.lit("Name"), F.lit("Balance"), F.lit("Customer")).alias("texts")), F.struct(F.lit(1).alias("row"), F.array(F.lit(""), F.lit("in USD"), F.lit("key")).alias("texts")))).alias("h"))
    head = head.select("c_nationkey", "h.row", "h.texts", F.lit(True).alias("header"), F.array_repeat(F.array().cast("array<string>"), 3).alias("paths"))
    cells = head.union(body.select("c_nationkey", "row", "texts", "header", "paths")).select(F.concat(F.lit("d"), s("c_nationkey")).alias("doc"), F.lit(1).alias("page"), F.lit(1).alias("table"), "row", "header", F.posexplode(F.arrays_zip("texts", "paths")).alias("col", "z"))
    cells = cells.select("doc", "page", "table", "row", "col", "header", F.col("z.paths").alias("path"), F.col("z.texts").alias("text"))
    start = 100 * F.col("row") + 30 * F.col("col")
    return cells.withColumn("start", start).withColumn("end", start + F.length("text"))


def schema(spark, sf_dir):
    """Three fields for every tenth customer; the schema of a nation is its document's."""
    own = printed(spark, sf_dir).where("c_custkey % 10 = 0")
    field = lambda q, kind, unit, strategy, columns: F.struct(F.lit(q).alias("quantity"), F.lit(kind).alias("kind"), F.lit(unit).cast("string").alias("unit"), F.lit(strategy).cast("string").alias("strategy"), F.array(*map(F.lit, columns)).cast("array<string>").alias("columns"))
    fields = F.array(field("balance", "decimal", "USD", "table_label", ["balance in USD", "Saldo"]), field("key/id", "count", None, "table_label", ["Customer key"]), field("other", "text", None, None, []))
    own = own.select(F.concat(F.lit("d"), s("c_nationkey")).alias("schema"), F.col("c_mktsegment").alias("endpoint"), F.lit("all").alias("timepoint"), F.col("c_name").alias("arm"), F.explode(fields).alias("f"))
    return own.select("schema", "endpoint", "timepoint", "arm", "f.*", F.array("arm").alias("rows"), F.array("endpoint").alias("sections"))


@query(
    "xtr_evidence",
    f"""WITH {PRINTED}, g AS (SELECT DISTINCT c_nationkey, c_mktsegment, 0 AS kind, NULL::BIGINT AS c_custkey, ['' , ''] AS texts, c_mktsegment AS label FROM p),
    r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, kind, c_custkey) AS row FROM (SELECT * FROM g UNION ALL SELECT c_nationkey, c_mktsegment, 1, c_custkey, ['USD ' || balance, key_text], c_name FROM p))
    SELECT 'd' || c_nationkey AS doc, row, col, CASE WHEN col = 0 THEN label ELSE texts[col] END AS text, label, CASE WHEN kind = 1 THEN c_mktsegment END AS section, ['Name', 'Balance in USD', 'Customer key'][col + 1] AS "column" FROM r, (VALUES (0), (1), (2)) v(col)""",
)
def xtr_evidence(spark, sf_dir):
    """Rows with their groups, columns with the words above them."""
    return located.evidence(laid_out(spark, sf_dir)).select("doc", "row", "col", "text", "label", "section", F.trim("column").alias("column"))


@query(
    "xtr_specification",
    """SELECT 'd' || c_nationkey AS schema, '/' || c_mktsegment || '/all/' || c_name || f.path AS path, [c_name] AS labels, [c_mktsegment] AS sections, f.columns AS columns
    FROM customer, (VALUES ('/balance', ['balance in USD', 'Saldo']), ('/key~1id', ['Customer key'])) f(path, columns) WHERE c_custkey % 10 = 0""",
)
def xtr_specification(spark, sf_dir):
    """Fields to a nested JSON specification and back."""
    out = located.fields_of(located.specification(schema(spark, sf_dir)))
    return out.select("schema", "path", F.col("locate.labels").alias("labels"), F.col("locate.section_labels").alias("sections"), F.col("locate.column_labels").alias("columns"))


@query(
    "xtr_located",
    f"""WITH {PRINTED}, g AS (SELECT DISTINCT c_nationkey, c_mktsegment, 0 AS kind, NULL::BIGINT AS c_custkey FROM p),
    r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, kind, c_custkey) + 1 AS row FROM (SELECT * FROM g UNION ALL SELECT c_nationkey, c_mktsegment, 1, c_custkey FROM p)),
    q AS (SELECT p.*, 'd' || p.c_nationkey AS doc, '/' || p.c_mktsegment || '/all/' || c_name AS base, r.row FROM p JOIN r ON r.c_custkey = p.c_custkey WHERE p.c_custkey % 10 = 0)
    SELECT doc, base || '/balance' AS path, 'extracted' AS status, balance AS value, 'USD' AS unit, 100 * row + 34 AS start, 100 * row + 34 + length(balance) AS "end" FROM q
    UNION ALL SELECT doc, base || '/key~1id', CASE WHEN key_text = 'NR' THEN 'missing' WHEN key_text LIKE 'about%' THEN 'invalid' ELSE 'extracted' END, CASE WHEN key_text <> 'NR' AND key_text NOT LIKE 'about%' THEN key_text END, NULL,
      CASE WHEN key_text <> 'NR' AND key_text NOT LIKE 'about%' THEN 100 * row + 60 END, CASE WHEN key_text <> 'NR' AND key_text NOT LIKE 'about%' THEN 100 * row + 60 + length(key_text) END FROM q
    UNION ALL SELECT doc, base || '/other', 'missing', NULL, NULL, NULL, NULL FROM q""",
)
def xtr_located(spark, sf_dir):
    """Proposals of a schema's fields, with the places of their values."""
    fields = schema(spark, sf_dir)
    cells = located.evidence(laid_out(spark, sf_dir)).withColumn("schema", F.col("doc"))
    cells = cells.withColumn("text", F.regexp_replace("text", "^USD ", "")).withColumn("start", F.when(F.col("col") == 1, F.col("start") + 4).otherwise(F.col("start")))
    found = located.located(cells, fields)
    documents = fields.select(F.col("schema").alias("doc"), "schema").distinct()
    return located.proposals(documents, fields, found).select("doc", "path", "status", "value", "unit", "start", "end")
