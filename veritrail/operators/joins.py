"""The joins, set operations and counts that the views are made of, as functions of DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side that is never broadcast: sizes are estimated from files, which don't tell how many rows an exploded column makes, and a broadcast passes through the driver."""
    return df.hint("merge")


def join_first_key(df: DataFrame, keys: list[Column], other: DataFrame, key: str) -> DataFrame:
    """df with other's columns, joined by the first of the keys that isn't null; rows without a match stay."""
    return df.withColumn(key, F.coalesce(*keys).cast(dict(other.dtypes)[key])).join(other, key, "left")


def first_match(df: DataFrame, sources: list[tuple[Column, DataFrame, str, str]], name: str) -> DataFrame:
    """df with `name`: the value of the first source that has the row's key. sources: (key of the row, source, its key, its value).

    A source has one row a key; each is joined once, so a row is never repeated.
    """
    out = df
    for i, (own, source, key, value) in enumerate(sources):
        side = source.select(F.col(key).alias(f"_key{i}"), F.col(value).alias(f"_value{i}"))
        out = out.join(side, own.cast(side.schema[0].dataType) == F.col(f"_key{i}"), "left")
    return out.select(*df.columns, F.coalesce(*[F.col(f"_value{i}") for i in range(len(sources))]).alias(name))


def kept(df: DataFrame, key: str, having: list[DataFrame] = (), lacking: list[DataFrame] = ()) -> DataFrame:
    """Rows whose key stands in every table of `having` and in none of `lacking`."""
    for other in having:
        df = df.join(other.select(key).distinct(), key, "left_semi")
    for other in lacking:
        df = df.join(other.select(key).distinct(), key, "left_anti")
    return df


def with_latest(df: DataFrame, key: str, other: DataFrame, column: str, name: str) -> DataFrame:
    """df with the greatest value of other's column at its key; null without one."""
    return df.join(other.groupBy(key).agg(F.max(column).alias(name)), key, "left")


def counts(df: DataFrame, by: list[str], conditions: dict[str, Column]) -> DataFrame:
    """One row a group: how many rows meet each condition."""
    return df.groupBy(*by).agg(*(F.count_if(c).alias(name) for name, c in conditions.items()))


def members(df: DataFrame, by: str, member: str, name: str = "members") -> DataFrame:
    """The sorted members of each group, as one array; groups are small (members of one report, region, set)."""
    return df.groupBy(by).agg(F.array_sort(F.collect_list(member)).alias(name))


def compare_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(kind, n): keys that both have, that only a has, that any has; one pass over both."""
    sides = a.select(key, F.lit(1).alias("_a"), F.lit(0).alias("_b")).union(b.select(key, F.lit(0), F.lit(1)))
    own = sides.groupBy(key).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    wide = own.agg(F.count_if(F.col("_a") + F.col("_b") == 2).alias("both"), F.count_if((F.col("_a") == 1) & (F.col("_b") == 0)).alias("only_a"), F.count(F.lit(1)).alias("any"))
    return wide.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, wide.columns)), F.array(*wide.columns))).alias("kind", "n"))


def covered(df: DataFrame, by: str, member: str, known: list) -> DataFrame:
    """(by, covered): whether all of a group's members are known."""
    return df.groupBy(by).agg(F.bool_and(F.col(member).isin(known)).alias("covered"))


def meeting(df: DataFrame, key: str, ids: Column, known: DataFrame, known_ids: Column) -> DataFrame:
    """Keys of df any of whose ids is among the known ones."""
    return df.select(key, F.explode(ids).alias("_id")).join(known.select(F.explode(known_ids).alias("_id")).distinct(), "_id", "left_semi").select(key).distinct()


def first_open(df: DataFrame, by: str, ref: str, order: list[str]) -> DataFrame:
    """(by, next): the first row of each group in order."""
    return df.groupBy(by).agg(F.min_by(ref, F.struct(*order)).alias("next"))
