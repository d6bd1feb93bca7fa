"""Reference data (JSON, CSV) and JSON event or work files as (pointer, value) rows or tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.functions.canonical import json_leaves
from veritrail.operators.folds import dealt


def json_reference(spark: SparkSession, path: str) -> DataFrame:
    """(pointer, value) of every leaf of a JSON file; value is canonical JSON, so null and missing differ."""
    return spark.read.text(path, wholetext=True).select(F.explode(json_leaves("value")).alias("l")).select(F.col("l.path").alias("pointer"), F.col("l.value").alias("value"))


def csv_reference(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a CSV file with a header; a short or long row fails."""
    out = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, mode="FAILFAST", enforceSchema=False)
    names = [c.strip() for c in out.columns]
    if len(set(names)) != len(names) or "" in names:
        raise ValueError("column names must be there and differ")
    return out


def lookup(table: DataFrame) -> DataFrame:
    """(key, value) of a two-column reference; of repeated keys, the last row stands."""
    key, value = table.columns
    place = F.monotonically_increasing_id()
    return table.withColumn("_p", place).groupBy(F.col(key).alias("key")).agg(F.max_by(value, "_p").alias("value"))


def bind(plan: DataFrame, reference: DataFrame) -> DataFrame:
    """plan (field, pointer) with expected values: found tells a missing pointer from a null value."""
    own = plan.join(reference, "pointer", "left")
    text = F.when(F.col("value").startswith('"'), F.from_json(F.concat(F.lit('{"v":'), "value", F.lit("}")), "v string")["v"]).when(F.col("value") != "null", F.col("value"))
    return own.select(*plan.columns, F.col("value").isNotNull().alias("found"), text.alias("expected"))


def works(spark: SparkSession, path: str, paths: dict[str, str]) -> DataFrame:
    """A provider's JSON lines as a common row: name -> JSON path."""
    return spark.read.text(path).select(*(F.get_json_object("value", p).alias(n) for n, p in paths.items()))


#: Elements of a search service's reply that tell of words it couldn't use, and what they mean.
NOTES = {"PhraseNotFound": "phrase not found", "QuotedPhraseNotFound": "quoted phrase not found", "PhraseIgnored": "ignored", "FieldNotFound": "unknown field"}


def hit_counts(answers: DataFrame) -> DataFrame:
    """(dialect, strategy, count, translation, warnings, problem) of recorded replies to counting a query (dialect, strategy, status, body).

    pubmed replies are XML with notes on its words, in their order; europepmc and clinicaltrials ones are JSON. A reply without a count has a problem instead. What
    Europe PMC counts without a word, an unknown field or unbalanced signs, is found by the library's own reading of the query.
    """
    from veritrail.functions import queries

    xml = F.when(F.col("dialect") == "pubmed", F.col("body"))
    count = F.when(F.col("dialect") == "pubmed", F.xpath_string(xml, F.lit("/eSearchResult/Count"))).when(F.col("dialect") == "europepmc", F.get_json_object("body", "$.hitCount")).otherwise(F.get_json_object("body", "$.totalCount"))
    error = F.nullif(F.xpath_string(xml, F.lit("/eSearchResult/ERROR")), F.lit(""))
    texts = F.concat(F.xpath(xml, F.lit("/eSearchResult/ErrorList/*/text()")), F.xpath(xml, F.lit("/eSearchResult/WarningList/*/text()")))
    tags = F.regexp_extract_all(F.concat(*(F.coalesce(F.regexp_extract(xml, f"(?s)<{l}>(.*)</{l}>", 1), F.lit("")) for l in ("ErrorList", "WarningList"))), F.lit("<([A-Za-z]+)>[^<]+<"), F.lit(1))
    said = F.create_map(*(F.lit(x) for pair in NOTES.items() for x in pair))
    notes = F.transform(F.arrays_zip(tags.alias("tag"), texts.alias("text")), lambda z: F.concat_ws(": ", F.try_element_at(said, z["tag"]), F.trim(z["text"])))

    @F.pandas_udf("array<string>")
    def found(strategy):  # a query is short, and there are as many as people write
        return strategy.map(lambda q: queries.problems(q or ""))

    number = count.try_cast("long")
    bad = F.when((F.col("status") < 200) | (F.col("status") >= 300), F.concat(F.lit("refused with HTTP "), F.col("status").cast("string"))).when(error.isNotNull(), error).when(number.isNull(), "no count in the reply")
    out = dealt(answers, "strategy").withColumn("problem", bad).withColumn("count", F.when(F.col("problem").isNull(), number))
    warnings = F.when(F.col("problem").isNotNull(), F.array().cast("array<string>")).when(F.col("dialect") == "pubmed", notes).when(F.col("dialect") == "europepmc", found(F.col("strategy"))).otherwise(F.array().cast("array<string>"))
    return out.select("dialect", "strategy", "count", F.when((F.col("dialect") == "pubmed") & F.col("problem").isNull(), F.nullif(F.xpath_string(xml, F.lit("/eSearchResult/QueryTranslation")), F.lit(""))).alias("translation"), warnings.alias("warnings"), "problem")
