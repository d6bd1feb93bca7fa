"""Checks of extracted values against each other: a result for every value a check looked at, passed or not.

Proposals have id, pop (population), grp (endpoint and time in it), arm, quantity, value (text), unit,
status and anchors (how many). Only extracted values take part; a missing value is never zero.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions.numbers import DECIMAL, as_decimal, well_formed
from veritrail.operators.joins import shuffled

KINDS = ["count", "percentage", "ratio", "p_value", "text"]
COUNTS = ["n_randomized", "n_analysed", "events"]
#: Quantities that are estimates with an interval; ratios are checked on the log scale, too.
RATIOS = ["risk_ratio", "odds_ratio", "hazard_ratio"]
ESTIMATES = [*RATIOS, "mean_difference", "risk_difference", "smd"]
SLACK = 0.05
TOTAL = "total"


def half_unit(value: Column) -> Column:
    """Half a unit in the last printed decimal."""
    places = F.when(F.contains(value, F.lit(".")), F.length(F.split_part(value, F.lit("."), F.lit(2)))).otherwise(0)
    return 0.5 * F.pow(F.lit(10.0), -places)


def _results(df: DataFrame, name: str, ids: list[str], problem: Column) -> DataFrame:
    """A row for each value involved."""
    own = df.withColumn("message", problem)
    return own.select(F.explode(F.array(*ids)).alias("id"), F.lit(name).alias("validator"), F.col("message").isNull().alias("passed"), "message")


def exact_values(proposals: DataFrame, fields: DataFrame) -> DataFrame:
    """fields (grp, arm, quantity, kind, field_unit): each value well formed, in its field's unit, with a source."""
    own = proposals.where("status = 'extracted'").join(shuffled(fields), ["grp", "arm", "quantity"], "left")
    shape = reduce(lambda c, k: c.when(F.col("kind") == k, well_formed(F.col("value"), k)), KINDS, F.when(F.lit(False), F.lit(None).cast("string")))
    problem = (
        F.when(F.col("kind").isNotNull() & F.col("value").isNull(), "an extracted field has no value")
        .when(F.col("kind").isNotNull() & shape.isNotNull(), shape)
        .when(F.col("kind").isNotNull() & ~F.col("unit").eqNullSafe(F.col("field_unit")), "the unit is not the field's unit")
        .when(F.coalesce(F.col("anchors"), F.lit(0)) == 0, "an extracted value has no source anchor")
    )
    return _results(own, "exact_value", ["id"], problem)


def denominators(numbers: DataFrame) -> DataFrame:
    """(grp, arm, n_id, n): analysed in the group, else randomized there, else either anywhere in the population."""
    n = numbers.where("quantity in ('n_analysed', 'n_randomized')").select("pop", "grp", "arm", F.struct((F.col("quantity") != "n_analysed").alias("second"), "id", F.col("number").alias("n")).alias("n"))
    near = n.groupBy("grp", "arm").agg(F.min("n").alias("near"))
    far = n.groupBy("pop", "arm").agg(F.min("n").alias("far"))
    own = numbers.select("pop", "grp", "arm").distinct().join(shuffled(near), ["grp", "arm"], "left").join(shuffled(far), ["pop", "arm"], "left")
    found = F.coalesce("near", "far")
    return own.select("grp", "arm", found["id"].alias("n_id"), found["n"].alias("n")).where("n_id is not null")


def validate(proposals: DataFrame, fields: DataFrame, arms: list[str]) -> DataFrame:
    """(id, validator, passed, message) of all checks. Of several proposals for one value (pop, grp, arm, quantity), the last by id takes part in checks against others."""
    key = ["pop", "grp", "arm", "quantity"]
    numbers = proposals.where("status = 'extracted'").withColumn("number", as_decimal(F.col("value"))).where("number is not null")
    numbers = numbers.groupBy(*key).agg(F.max_by(F.struct(*[c for c in numbers.columns if c not in key]), "id").alias("_p")).select(*key, "_p.*")
    of = lambda q, name: numbers.where(F.col("quantity") == q).select("grp", "arm", F.col("id").alias(f"{name}_id"), F.col("number").alias(name), F.col("value").alias(f"{name}_text"))
    text = lambda c: F.regexp_replace(c.cast("string"), r"\.?0+$", "")
    n = denominators(numbers)
    events = of("events", "e").join(shuffled(n), ["grp", "arm"])
    out = [exact_values(proposals, fields), _results(events, "events_at_most_n", ["e_id", "n_id"], F.when(F.col("e") > F.col("n"), F.concat(F.col("e_text"), F.lit(" events exceed N"))))]
    share = of("percent", "p").join(shuffled(events), ["grp", "arm"]).where("n > 0")
    recomputed = 100 * F.col("e").cast("double") / F.col("n").cast("double")
    off = F.abs(recomputed - F.col("p").cast("double")) > half_unit(F.col("p_text")) + 1e-9
    out.append(_results(share, "percent_recomputes", ["p_id", "e_id", "n_id"], F.when(off, F.concat(F.lit("events / N is "), F.format_number(recomputed, 2), F.lit("%")))))
    total = numbers.where((F.col("arm") == TOTAL) & F.col("quantity").isin(COUNTS)).select("grp", "quantity", F.col("id").alias("t_id"), F.col("number").alias("t"))
    parts = numbers.where(F.col("arm").isin(arms)).groupBy("grp", "quantity").agg(F.countDistinct("arm").alias("found"), F.sum("number").cast(DECIMAL).alias("sum"), F.collect_list("id").alias("ids"))
    sums = total.join(shuffled(parts.where(F.col("found") == len(arms))), ["grp", "quantity"]).withColumn("all", F.concat(F.array("t_id"), "ids"))
    wrong = F.when(F.col("sum") != F.col("t"), F.concat(F.lit("the arms add up to "), text(F.col("sum"))))
    out.append(sums.withColumn("message", wrong).select(F.explode("all").alias("id"), F.lit("arms_sum_to_total").alias("validator"), F.col("message").isNull().alias("passed"), "message"))
    ratio = numbers.where(F.col("quantity").isin(ESTIMATES)).select("grp", "arm", "quantity", F.col("id").alias("r_id"), F.col("number").cast("double").alias("r"), F.col("value").alias("r_text"))
    bounds = ratio.join(shuffled(of("ci_lower", "lo")), ["grp", "arm"]).join(shuffled(of("ci_upper", "hi")), ["grp", "arm"])
    lo, hi, r = F.col("lo").cast("double"), F.col("hi").cast("double"), F.col("r")
    bracket = F.when(lo >= hi, "the interval is empty or reversed").when((r < lo) | (r > hi), "the interval does not contain the estimate")
    three = ["r_id", "lo_id", "hi_id"]
    out.append(_results(bounds, "ci_brackets_estimate", three, bracket))
    width = (F.log(hi) - F.log(lo)) / 2
    rounding = half_unit(F.col("r_text")) / r + (half_unit(F.col("lo_text")) / lo + half_unit(F.col("hi_text")) / hi) / 2
    centre = F.abs(F.log(r) - (F.log(lo) + F.log(hi)) / 2) > rounding + SLACK * width
    out.append(_results(bounds.where(bracket.isNull() & (lo > 0) & (F.col("quantity").isin(RATIOS))), "ratio_log_symmetric", three, F.when(centre, "the ratio is off the centre of its interval on the log scale")))
    return reduce(DataFrame.union, out)
