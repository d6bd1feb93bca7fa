"""Opening of screening stages, effects of decisions, bulk decisions, undo, acceptance of values. State is folded from events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrail.operators.ranking import seeded_key


def opened(items: DataFrame, readers: list[str], seed: str, double: bool, audit_percent: float, sentinels: DataFrame | None = None) -> DataFrame:
    """Assignments of a stage (item, reader, role, assignment_id): one or two readers in turn along the seeded order,
    an audit reader for the first `audit_percent` of it, and known records to every reader as sentinels.

    Ids follow from their parts, so opening a stage again gives the same ones.
    """
    total = items.count()
    audited = -(-total * audit_percent // 100)
    # places in the whole order: rank within a slice of the hash range, after the rows of the slices before
    own = items.select("item", seeded_key(seed, F.col("item")).alias("h")).withColumn("slice", F.substring("h", 1, 3))
    before = F.sum("c").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))  # at most 4,096 slices
    offsets = own.groupBy("slice").agg(F.count(F.lit(1)).alias("c")).select("slice", F.coalesce(before, F.lit(0)).alias("skip"))
    inside = F.row_number().over(Window.partitionBy("slice").orderBy("h", "item")) - 1
    own = own.withColumn("i", inside).join(F.broadcast(offsets), "slice").withColumn("n", F.col("i") + F.col("skip"))
    pool = F.array(*map(F.lit, readers))
    at = lambda shift: F.get(pool, ((F.col("n") + shift) % len(readers)).cast("int"))
    roles = [F.struct(at(0).alias("reader"), F.lit("first").alias("role"))]
    if double:
        roles.append(F.struct(at(1).alias("reader"), F.lit("second").alias("role")))
    audit = F.when(F.col("n") < audited, F.struct(at(len(roles)).alias("reader"), F.lit("audit").alias("role")))
    out = own.select("item", F.explode(F.array_compact(F.array(*roles, audit))).alias("r")).select("item", "r.reader", "r.role")
    if sentinels is not None:
        out = out.union(sentinels.select("item", F.explode(pool).alias("reader"), F.lit("sentinel").alias("role")))
    return out.withColumn("assignment_id", F.sha2(F.concat_ws("\x1f", F.lit(seed), "item", "reader", "role"), 256))


def after_decision(open_kinds: Column, settled: Column, kinds: Column) -> Column:
    """Conflict kinds that are open after a decision: those open stay with the new ones merged in, settled ones don't open again."""
    none = F.array().cast("array<string>")
    fresh = F.array_except(kinds, F.coalesce(settled, none))
    return F.array_sort(F.array_union(F.coalesce(open_kinds, none), fresh))


def bulk(rows: DataFrame, assignments: DataFrame, reviewer: str, outcome: str, criterion: str | None, batch: str) -> DataFrame:
    """One decision per row under the rules of single ones; a row that breaks them is refused with its reason."""
    own = rows.join(assignments.where(F.col("reader") == reviewer).select("item", "assignment_id", "decided"), "item", "left")
    why = F.when(F.col("assignment_id").isNull(), "not_assigned").when(F.col("decided"), "already_decided").when(F.lit(outcome == "exclude" and criterion is None), "criterion_missing")
    decided = F.when(why.isNull(), F.struct(F.lit(outcome).alias("outcome"), F.lit(criterion).cast("string").alias("criterion"), F.lit(batch).alias("batch")))
    return own.select("item", "assignment_id", why.alias("refused"), decided.alias("decision"))


def effective(events: DataFrame) -> DataFrame:
    """events (assignment, seq, kind: decide, undo, withdraw, adjudicate; outcome): what holds for each assignment.

    An undo takes back the decision before it; a withdrawal leaves none; an adjudication overrides all.
    """
    own = events.groupBy("assignment").agg(
        F.array_sort(F.collect_list(F.struct("seq", "kind", "outcome"))).alias("all"),
        F.max_by("outcome", F.when(F.col("kind") == "adjudicate", F.col("seq"))).alias("ruled"),
    )
    none = F.slice(F.transform("all", lambda e: e["outcome"]), 1, 0)
    stack = F.aggregate(
        "all",
        none,
        lambda s, e: F.when(e["kind"] == "decide", F.concat(s, F.array(e["outcome"]))).when(e["kind"] == "undo", F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).when(e["kind"] == "withdraw", F.slice(s, 1, 0)).otherwise(s),
    )
    return own.select("assignment", F.coalesce("ruled", F.element_at(F.when(F.size(stack) > 0, stack), -1)).alias("outcome"))


def acceptance_problems(acceptances: DataFrame) -> DataFrame:
    """Acceptances (key, state, edited, note, both_agree, gated): what forbids each; a group holds only if none is forbidden."""
    why = (
        F.when(F.col("state") == "conflict", F.when(~F.col("edited"), "conflict_needs_an_edit"))
        .when(F.col("edited") & (F.trim(F.coalesce("note", F.lit(""))) == ""), "edit_needs_a_note")
        .when(F.col("gated") & ~F.col("both_agree"), "gate_needs_agreement")
    )
    own = acceptances.withColumn("problem", why)
    bad = own.groupBy("group_id").agg(F.bool_or(F.col("problem").isNotNull()).alias("_bad"))
    return own.join(bad, "group_id").withColumn("accepted", F.when(F.col("group_id").isNull(), F.col("problem").isNull()).otherwise(~F.col("_bad"))).drop("_bad")
