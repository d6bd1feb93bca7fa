"""Quality rules: rule failures by host, rates shrunk by an empirical beta prior, verdicts joined back.

Each text gets counts (words, symbols, repeated lines, words in repeated three-word windows)
and rule failures. A host's failures and documents are summed; a beta prior fitted to the
hosts' rates by moments draws the rates of small hosts towards the mean; a host whose shrunk
rate passes `limit` is rejected with all its documents. All of it is built-in functions.

Defined cases: a null text has no words and fails; a null host is a host of its own; with one
host, or equal rates everywhere, the prior counts as `most_weight` documents; repeated rows count
as often as they stand; an empty table gives an empty result.

A window of three words is compared by its 64-bit hash within its document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import WORD_GAP, materialize, table

GAPS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


def repeat_words(w: Column) -> Column:
    """Words of w that lie in three-word windows which stand in w twice or more."""
    windows = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
    return F.aggregate(F.array(F.sort_array(windows)), F.lit(0), lambda _, s: covered(s))


def covered(s: Column) -> Column:
    """s: windows sorted by hash. The words that those with an equal neighbour cover."""
    twice = F.filter(s, lambda e, k: (e["h"] == F.get(s, k - 1)["h"]) | (e["h"] == F.get(s, k + 1)["h"]))
    starts = F.sort_array(F.transform(twice, lambda e: e["i"]))
    return F.aggregate(F.array(starts), F.lit(0), lambda _, p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, n: a + n))


def text_key(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.xxhash64(text.cast("string")))


def text_counts(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words (long), prefixed _q."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, GAPS, "") != "")
    out = docs.withColumn("_q_words", words(text)).withColumn("_q_lines", lines)
    return out.withColumns(
        {
            "_q_n_words": F.size("_q_words").cast("long"),
            "_q_word_chars": F.length(F.translate(text, GAPS, "")).cast("long"),
            "_q_n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "_q_n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
            "_q_n_lines": F.size("_q_lines").cast("long"),
            "_q_n_repeat_words": repeat_words(F.col("_q_words")).cast("long"),
        }
    ).drop("_q_words", "_q_lines")


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def host_rules(docs: DataFrame, host: str = "source", limit: float = 0.5, most_weight: float = 1000.0, broadcast_hosts: int = 100_000) -> DataFrame:
    """doc_id, the counts, base_failed, host, host_rate (shrunk), kept, and _key (hash of the text) of every row.

    Rows of one doc_id, _key and host are judged alike, so these three name a verdict even where ids are null or repeated.
    """
    narrow = text_counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("_key"), "text", F.coalesce(F.concat(F.lit("h"), F.col(host).cast("string")), F.lit("n")).alias("host")))
    narrow = narrow.select("doc_id", "_key", "host", *(F.col(f"_q_{c}").alias(c) for c in COUNTS), F.col("_q_n_lines").alias("n_lines"))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    symbols = 10 * F.col("n_symbols") > 5 * F.col("n_words")
    lines = 10 * F.col("n_dup_lines") > 3 * F.col("n_lines")
    narrow = materialize(narrow.withColumn("base_failed", base).withColumn("failed", base | symbols | lines), "quality")
    hosts = narrow.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("k"))
    rate = F.col("k") / F.col("n")
    p = hosts.agg(F.count(F.lit(1)).alias("hosts"), F.avg(rate).alias("mean"), F.var_pop(rate).alias("var")).first()
    weight = most_weight
    mean = p["mean"] if p["mean"] is not None else 0.5
    if p["var"] and 0 < mean < 1:
        weight = min(most_weight, max(1.0, mean * (1 - mean) / p["var"] - 1))
    verdicts = hosts.select("host", ((F.col("k") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))).alias("host_rate"))
    if p["hosts"] <= broadcast_hosts:
        verdicts = F.broadcast(verdicts)
    out = narrow.join(verdicts, "host")
    return out.select("doc_id", *COUNTS, "base_failed", F.expr("if(host = 'n', null, substr(host, 2))").alias("host"), "host_rate", (~F.col("base_failed") & (F.col("host_rate") <= limit)).alias("kept"), "_key")


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    return host_rules(table(spark, sf_dir, "documents")).select("doc_id", *COUNTS, "base_failed", "kept")
