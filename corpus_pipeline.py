"""Five stages from raw documents to token files; each works on what its predecessor kept.

quality rules -> n-gram Jaccard join -> benchmark decontamination -> mixing -> token ids.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm.common import materialize, new_path, table
from veritrail.llm.decontamination import decontaminate
from veritrail.llm.jaccard_join import jaccard_join
from veritrail.llm.mixing import TARGETS, mixing_rates, mixed
from veritrail.llm.quality import host_rules, text_key
from veritrail.llm.token_output import read_tokens, write_tokens


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and their host's verdict keep. Each row has its own verdict, by id, text and host."""
    kept = host_rules(docs).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("_key").alias("kept_text"), F.col("host").alias("kept_host")).distinct()
    own = docs.select(F.struct("*").alias("row"))  # so that no column of docs can clash
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("kept_id")) & (text_key(F.col("row.text")) == F.col("kept_text")) & F.col("row.source").cast("string").eqNullSafe(F.col("kept_host"))
    return own.join(kept, same, "left_semi").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each linked group: the one with the least doc_id (null: after all others), once.

    Rows are known by a 64-bit hash of id and text, so null and repeated ids are no different from others;
    rows that agree in both are one document and stay once (the first by its columns as JSON).
    """
    number = lambda id_, text: F.xxhash64(F.lit(21), id_.cast("long"), id_.isNull(), text_key(text))
    own = number(F.col("doc_id"), F.col("text"))
    links = jaccard_join(docs.select(own.alias("doc_id"), F.col("text")), chunk_bytes=6 << 20)
    ids = docs.groupBy(own.alias("number")).agg(F.first(F.col("doc_id").cast("long")).alias("doc_id"), F.count(F.lit(1)).alias("times"))
    first = F.min_by(F.struct("number", "times"), F.struct(F.col("doc_id").isNull(), "doc_id", "number")).alias("kept")
    kept = links.select(F.col("doc_id").alias("number"), F.col("component_id").alias("component")).distinct().join(ids, "number").groupBy("component").agg(first).select("kept.*")
    kept = materialize(kept, "kept")
    rows = docs.select(F.struct("*").alias("row")).withColumn("number", number(F.col("row.doc_id"), F.col("row.text"))).join(kept, "number")
    again = rows.where("times > 1").groupBy("number").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return rows.where("times = 1").select("row.*").union(again.select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say: the whole part, and once more by a draw on the doc_id's hash."""
    return mixed(docs, mixing_rates(docs, table(spark, sf_dir, "labels"), TARGETS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from the token files."""
    return read_tokens(write_tokens(docs, new_path(spark, "tokens"), file_bytes=4 << 20))


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("mixing", mixing), ("token output", tokens)]
#: The mixing and coding stages have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
