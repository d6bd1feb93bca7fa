"""Comparison of extracted values with reference values, field by field and row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions import numbers, text


def compare_fields(plan: DataFrame, extraction: DataFrame, normalizers: list[str] | None = None) -> DataFrame:
    """plan (field, expected, operator, absolute, relative, severity) with extraction (field, actual, status).

    match_status: ambiguous and not_compared follow the extraction or a missing expectation;
    else match or mismatch, and only a mismatch has a severity.
    """
    both = plan.join(extraction, "field", "left")
    norm = lambda c: text.normalize(F.col(c), normalizers or [])
    same = numbers.agrees(norm("expected"), norm("actual"), F.col("operator"), F.col("absolute"), F.col("relative"))
    status = (
        F.when(F.col("status") == "ambiguous", "ambiguous")
        .when(F.col("expected").isNull() | F.col("status").isNull() | (F.col("status") != "extracted"), "not_compared")
        .when(same, "match")
        .otherwise("mismatch")
    )
    return both.withColumn("match_status", status).withColumn("shown_severity", F.when(F.col("match_status") == "mismatch", F.col("severity")))


def compare_rows(reference: DataFrame, document: DataFrame, keys: list[str], expected: str, actual: str, absolute: float | None = None, relative: float | None = None) -> DataFrame:
    """Full outer comparison on keys: match, mismatch, not_in_reference or not_in_document."""
    a = reference.select(*keys, F.col(expected).alias("expected"), F.lit(1).alias("_a"))
    b = document.select(*keys, F.col(actual).alias("actual"), F.lit(1).alias("_b"))
    both = a.join(b, keys, "full_outer")
    same = numbers.agrees(F.col("expected").cast("string"), F.col("actual").cast("string"), F.lit("numeric"), F.lit(absolute).cast("double"), F.lit(relative).cast("double"))
    status = F.when(F.col("_a").isNull(), "not_in_reference").when(F.col("_b").isNull(), "not_in_document").when(same, "match").otherwise("mismatch")
    return both.select(*keys, "expected", "actual", status.alias("match_status"))


def summarize(comparisons: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts by status, coverage of all fields, agreement over those compared (null if none)."""
    count = lambda s: F.sum(F.when(F.col("match_status") == s, 1).otherwise(0))
    t = comparisons.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("fields"), count("match").alias("matches"), count("mismatch").alias("mismatches"), count("not_compared").alias("not_compared"), count("ambiguous").alias("ambiguous"))
    compared = F.col("matches") + F.col("mismatches")
    return t.select("*", F.try_divide(compared, F.col("fields")).alias("coverage"), F.try_divide(F.col("matches"), compared).alias("agreement"))


def review_score(summary: DataFrame, extracted: Column, structure: Column) -> DataFrame:
    """0.5 for what was extracted, 0.3 for what matches, 0.2 for structure."""
    return summary.withColumn("score", 0.5 * extracted + 0.3 * F.coalesce(F.col("agreement"), F.lit(0.0)) + 0.2 * structure)


def diff_paths(before: DataFrame, after: DataFrame, path: str = "path", value: str = "value") -> DataFrame:
    """Added, removed and changed (path, value) rows of two flattened documents."""
    a = before.select(path, F.col(value).alias("old"), F.lit(1).alias("_a"))
    b = after.select(path, F.col(value).alias("new"), F.lit(1).alias("_b"))
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return a.join(b, path, "full_outer").select(path, "old", "new", kind.alias("kind")).where("kind is not null")


def parts_total(parts: DataFrame, totals: DataFrame, keys: list[str], part: str, total: str) -> DataFrame:
    """Whether the parts of each key sum to its total, as exact decimals."""
    summed = parts.groupBy(*keys).agg(F.sum(F.col(part).cast(numbers.DECIMAL)).cast(numbers.DECIMAL).alias("sum_of_parts"))
    both = totals.select(*keys, F.col(total).cast(numbers.DECIMAL).alias("total")).join(summed, keys, "left")
    return both.withColumn("problem", F.when(F.col("sum_of_parts").isNull(), "no_parts").when(F.col("sum_of_parts") != F.col("total"), "sum_differs"))


def share_recomputes(part: Column, whole: Column, printed: Column) -> Column:
    """Whether a printed percentage is the share of part in whole, within half its last printed unit."""
    digits = F.when(F.contains(printed, F.lit(".")), F.length(F.split_part(printed, F.lit("."), F.lit(2)))).otherwise(0)
    gap = F.abs(100 * part.cast("decimal(20,6)") / whole.cast("decimal(20,6)") - printed.cast("decimal(20,6)"))
    return gap <= (F.lit(0.5) * F.pow(F.lit(10.0), -digits)).cast("decimal(20,9)")


def overlay(values: DataFrame, corrections: DataFrame, key: str, value: str) -> DataFrame:
    """A reviewer's corrections over the values read: the latest correction of a key stands."""
    last = corrections.groupBy(key).agg(F.max_by(value, "seq").alias("_new"))
    return values.join(last, key, "left").withColumn("corrected", F.col("_new").isNotNull()).withColumn(value, F.coalesce("_new", value)).drop("_new")


def reconcile(first: DataFrame, second: DataFrame, keys: list[str], value: str, recheck_every: int = 10) -> DataFrame:
    """Agreement of two extraction paths on a semantic key; about one agreed key in `recheck_every` is checked again.

    Nothing extracted on either side never agrees.
    """
    a, b = (d.select(*keys, F.col(value).alias(n)) for d, n in ((first, "first"), (second, "second")))
    both = a.join(b, keys, "full_outer")
    state = (
        F.when(F.col("first").isNull() & F.col("second").isNull(), "neither")
        .when(F.col("first").isNull(), "second_only")
        .when(F.col("second").isNull(), "first_only")
        .when(numbers.same_value(F.col("first"), F.col("second")), "agreed")
        .otherwise("conflict")
    )
    digest = F.sha2(F.concat_ws("\x1f", *[F.col(k).cast("string") for k in keys]), 256)
    picked = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % recheck_every == 0
    return both.withColumn("state", state).withColumn("recheck", (F.col("state") == "agreed") & picked)
