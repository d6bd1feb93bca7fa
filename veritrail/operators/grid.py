"""Grid views over records: filters, facets, typo-tolerant search, multi-key sort, saved views."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions import similarity, text
from veritrail.plans.session import written

EMPTY = "(empty)"


def values_of(df: DataFrame, column: str) -> Column:
    """The values of a cell, as texts; an empty cell has the one value EMPTY."""
    kind = dict(df.dtypes)[column]
    own = F.transform(F.col(column), lambda v: v.cast("string")) if kind.startswith("array") else F.array(F.col(column).cast("string"))
    own = F.filter(F.coalesce(own, F.array().cast("array<string>")), lambda v: v.isNotNull() & (v != ""))
    return F.when(F.size(own) == 0, F.array(F.lit(EMPTY))).otherwise(own)


def condition(df: DataFrame, column: str, rule: dict) -> Column:
    """values: any value of the cell is among them; contains: any value holds the text, whatever the case."""
    own, out = values_of(df, column), F.lit(True)
    if rule.get("values") is not None:
        out = out & F.arrays_overlap(own, F.array(*map(F.lit, rule["values"])))
    if rule.get("contains"):
        out = out & F.exists(own, lambda v: F.contains(F.lower(v), F.lit(rule["contains"].lower())))
    return out


def filtered(df: DataFrame, filters: dict[str, dict], but: str | None = None) -> DataFrame:
    for column, rule in filters.items():
        if column != but:
            df = df.where(condition(df, column, rule))
    return df


def facets(df: DataFrame, filters: dict[str, dict]) -> DataFrame:
    """For each filtered column, its values under all other filters, with counts."""
    out = None
    for column in filters:
        own = filtered(df, filters, but=column)
        own = own.select(F.lit(column).alias("column"), F.explode(F.array_distinct(values_of(own, column))).alias("value")).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        out = own if out is None else out.union(own)
    return out


def number_aware(column: Column) -> Column:
    """A text as a sort key: lower case, each run of digits behind its length, so that numbers of any length compare as numbers."""
    plain = lambda p: F.regexp_replace(p, r"^0+(?=\d)", "")
    digits = lambda p: F.concat(F.lpad(F.length(plain(p)).cast("string"), 8, "0"), plain(p))
    parts = F.regexp_extract_all(F.lower(column.cast("string")), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), digits(p)).otherwise(p)), "")


def ordered(df: DataFrame, keys: list[tuple[str, bool]], position: str) -> DataFrame:
    """By (column, descending) keys; numbers inside texts count as numbers, empties are last both ways, ties keep input order."""
    order = []
    for column, down in keys:
        own = F.col(column) if dict(df.dtypes)[column] in ("int", "bigint", "double", "float", "date", "timestamp") else number_aware(F.col(column))
        own = F.when(F.col(column).cast("string") != "", own)
        order.append(own.desc_nulls_last() if down else own.asc_nulls_last())
    return df.orderBy(*order, position)


#: Letters and digits: what a search compares.
WORD = r"(?U)[\p{L}\p{N}]+"
#: Terms up to this long are looked up in the index; the forms of a word grow with its square, so longer terms are compared with all words.
LONG = 24


def _folded(c: Column) -> Column:
    return F.lower(text.without_marks(F.coalesce(c, F.lit(""))))


def slack(term: str) -> int:
    """Typos allowed in a term: none in a short one, where a typo is another word."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


def _lacking(word: Column) -> Column:
    """The forms of a word that lack one character."""
    n = F.length(word)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))).otherwise(F.array(word))


def search_index(df: DataFrame, key: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(postings, forms) of the words of short fields, written once and searched often.

    postings: word, key. forms: form, size, word: what is left of a word, or of its first `size` characters (size 0: of the whole word), without
    one character, or two where a term may be long enough for two typos. Two words with so many typos between them, a swap of neighbours being one, share a form.
    """
    words = F.explode(F.array_distinct(F.regexp_extract_all(_folded(F.concat_ws(" \u0001 ", *fields)), F.lit(WORD), F.lit(0))))
    postings = written(df.select(F.col(key).alias("key"), words.alias("word")))
    vocabulary = postings.select("word").distinct().where(F.length("word") >= 4).withColumn("n", F.length("word"))
    none = F.array().cast("array<struct<size:int,part:string>>")
    whole = F.when(F.col("n") <= LONG + 2, F.array(F.struct(F.lit(0).alias("size"), F.col("word").alias("part")))).otherwise(none)
    fronts = F.when(F.col("n") > 5, F.transform(F.sequence(F.lit(5), F.least(F.col("n") - 1, F.lit(LONG))), lambda i: F.struct(i.alias("size"), F.substr("word", F.lit(1), i).alias("part")))).otherwise(none)
    parts = vocabulary.select("word", F.explode(F.concat(whole, fronts)).alias("p")).select("word", "p.size", "p.part")
    one = F.concat(F.array("part"), _lacking(F.col("part")))
    # two typos are allowed in terms of nine characters and more: wholes of seven and more, fronts of nine and more
    deep = F.when(F.col("size") == 0, F.length("part") >= 7).otherwise(F.col("size") >= 9)
    forms = F.when(deep, F.concat(one, F.flatten(F.transform(_lacking(F.col("part")), _lacking)))).otherwise(one)
    return postings, written(parts.select(F.explode(F.array_distinct(forms)).alias("form"), "size", "word"))


def _forms(term: str) -> set[str]:
    out = {term}
    for _ in range(slack(term)):
        out |= {w[:i] + w[i + 1 :] for w in out for i in range(len(w))}
    return out


def searched(df: DataFrame, query: str, fields: list[str], abstract: str | None, key: str, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Rows (unique by key) in which every term of the query is found, with points: within the short fields 3, with typos in one of their words or its front 2, in the abstract 1.

    Typos are looked up by the terms' forms in the index (made here if none is given); only words that share a form are compared.
    """
    spark = df.sparkSession
    terms = list(dict.fromkeys(re.findall(r"[^\W_]+", "".join(c for c in unicodedata.normalize("NFD", query) if not unicodedata.category(c).startswith("M")).lower())))
    if not terms:
        return df.withColumn("points", F.lit(None).cast("int")).limit(0)
    postings, forms = index or search_index(df, key, fields)
    asked = [(t, slack(t), f, size) for t in terms if slack(t) and len(t) <= LONG for f in _forms(t) for size in (0, len(t))]
    asked = spark.createDataFrame(asked, "term string, limit int, form string, size int")
    near = forms.join(F.broadcast(asked), ["form", "size"]).select("term", "limit", "size", "word").distinct()  # asked: the forms of one query's terms
    for t in (t for t in terms if len(t) > LONG):
        for size, n in ((0, F.length("word")), (len(t), F.lit(len(t)))):
            alike = postings.select("word").distinct().where(F.levenshtein(F.substr("word", F.lit(1), n), F.lit(t), 2 * slack(t)) >= 0)
            near = near.union(alike.select(F.lit(t), F.lit(slack(t)), F.lit(size), "word"))
    part = F.when(F.col("size") > 0, F.substr("word", F.lit(1), F.col("size"))).otherwise(F.col("word"))
    close = reduce(lambda c, k: c.when(F.col("limit") == k, similarity.osa_distance(k)(F.col("term"), part)), (1, 2), F.when(F.lit(False), F.lit(None).cast("int")))
    typos = near.withColumn("_d", close).where(F.col("_d") <= F.col("limit")).select("term", "word").distinct()
    held = postings.join(typos, "word").groupBy("key").agg(F.collect_set("term").alias("_typos")).withColumnRenamed("key", "_key")
    own = df.withColumn("_short", _folded(F.concat_ws(" \u0001 ", *fields))).withColumn("_long", _folded(F.col(abstract)) if abstract else F.lit(""))
    own = own.join(held, F.col(key) == F.col("_key"), "left")
    points = [F.when(F.contains("_short", F.lit(t)), 3).when(F.coalesce(F.array_contains("_typos", t), F.lit(False)), 2).when(F.contains("_long", F.lit(t)), 1) for t in terms]
    return own.withColumn("points", sum(points[1:], points[0])).where("points is not null").drop("_short", "_long", "_typos", "_key")


def saved_view(df: DataFrame, view: str, position: str) -> DataFrame:
    """A view kept as JSON: filters, sort, query with its fields, columns."""
    plan = json.loads(view)
    out = filtered(df, plan.get("filters", {}))
    if plan.get("query"):
        out = searched(out, plan["query"], plan["fields"], plan.get("abstract"), position)
    out = ordered(out, [(c, d) for c, d in plan.get("sort", [])], position)
    return out.select(*plan["columns"]) if plan.get("columns") else out
