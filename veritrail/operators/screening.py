"""Screening: outcomes, conflicts, reveals, proposals, flow counts, audit strata, merged sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outcomes(decisions: DataFrame, item: str, reviewer: str, outcome: str, seq: str, readers: int = 2) -> DataFrame:
    """Item outcome from each reviewer's last decision: pending under `readers`, conflict where they differ."""
    last = decisions.groupBy(item, reviewer).agg(F.max_by(outcome, seq).alias("_o"))
    n, kinds = F.count(F.lit(1)), F.countDistinct("_o")
    return last.groupBy(item).agg(n.alias("readers"), F.when(n < readers, "pending").when(kinds > 1, "conflict").otherwise(F.min("_o")).alias("outcome"))


def conflict_kinds(stage: Column, finals: Column, auditor: Column) -> Column:
    """finals: array of struct(outcome, criterion). human_disagreement, exclusion_reason (full text), audit_disagreement."""
    sides = F.array_distinct(F.transform(finals, lambda f: f["outcome"]))
    reasons = F.array_distinct(F.transform(F.filter(finals, lambda f: f["outcome"] == "exclude"), lambda f: f["criterion"]))
    return F.array_compact(
        F.array(
            F.when(F.size(sides) > 1, "human_disagreement"),
            F.when((stage == "full_text") & (F.size(sides) == 1) & (F.size(reasons) > 1), "exclusion_reason"),
            F.when(auditor.isNotNull() & ~F.array_contains(sides, auditor), "audit_disagreement"),
        )
    )


def reveal_basis(setting: Column, decision: Column, reading: Column) -> Column:
    """Whether a model reading is shown after a provisional decision: always, or on disagreement only."""
    return F.when((setting == "always") & reading.isNotNull(), "setting").when((setting == "disagreement") & (reading != decision), "disagreement")


def excluding_criteria(criteria: Column) -> Column:
    """criteria: array of struct(id, status, verified, failed_check). The verified 'not met' answers without a failed check."""
    return F.filter(criteria, lambda c: (c["status"] == "not_met") & c["verified"] & c["failed_check"].isNull())


def verdict_excludes(criteria: Column) -> Column:
    return F.size(excluding_criteria(criteria)) > 0


def proposal(criteria: Column, untrusted: Column, working: Column) -> Column:
    """struct(outcome, criterion): a verified exclusion first, then (working level) an unverified one, else include; null if untrusted."""
    first = F.get(excluding_criteria(criteria), F.lit(0))["id"]
    loose = F.get(F.filter(criteria, lambda c: c["status"] == "not_met"), F.lit(0))["id"]
    own = F.when(first.isNotNull(), first).when(working & loose.isNotNull(), loose)
    return F.when(~untrusted, F.struct(F.when(own.isNotNull(), "exclude").otherwise("include").alias("outcome"), own.alias("criterion")))


def ai_rank(criteria: Column) -> Column:
    """1000 if the reading excludes, plus the criteria not met."""
    return F.when(verdict_excludes(criteria), 1000).otherwise(0) + F.size(F.filter(criteria, lambda c: c["status"] == "not_met"))


def rescreen_reason(mode: Column, finals: Column, reading: Column) -> Column:
    """Why an item is screened again: single reader against the reading, or an exclusion the reading doesn't share."""
    one = F.get(finals, F.lit(0))
    return F.when((mode == "single_with_ai") & (one == "exclude") & (reading == "include"), "reading_includes").when((mode == "single_with_ai") & (one == "include") & (reading == "exclude"), "reading_excludes")


def decision_problems(decision: Column, stage: Column, criteria: Column) -> Column:
    """decision: struct(outcome, criterion, reason). Rules of its stage that it breaks."""
    o = decision["outcome"]
    return F.array_compact(
        F.array(
            F.when(~o.isin("include", "exclude", "unclear"), "unknown_outcome"),
            F.when((stage == "full_text") & (o == "unclear"), "unclear_at_full_text"),
            F.when((o == "exclude") & (stage == "full_text") & decision["criterion"].isNull(), "criterion_missing"),
            F.when(decision["criterion"].isNotNull() & ~F.array_contains(criteria, decision["criterion"]), "unknown_criterion"),
            F.when((o != "exclude") & decision["criterion"].isNotNull(), "criterion_without_exclusion"),
        )
    )


def reveals_kept(events: DataFrame) -> DataFrame:
    """events (assignment, seq, kind: provisional, reveal, final; outcome): each revealed decision with the next final."""
    shown = events.where("kind = 'reveal'").select("assignment", F.col("seq").alias("at"))
    before = events.where("kind = 'provisional'").select("assignment", F.col("seq").alias("p"), F.col("outcome").alias("provisional"))
    final = events.where("kind = 'final'").select("assignment", F.col("seq").alias("f"), F.col("outcome").alias("final"))
    a = shown.join(before, "assignment").where("p < at").groupBy("assignment", "at").agg(F.max_by("provisional", "p").alias("provisional"))
    b = shown.join(final, "assignment").where("f > at").groupBy("assignment", "at").agg(F.min_by("final", "f").alias("final"))
    return a.join(b, ["assignment", "at"], "left").withColumn("kept", F.col("provisional") == F.col("final"))


def audit_strata(df: DataFrame, by: str, sampled: Column, relevant: Column) -> DataFrame:
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return df.groupBy(F.col(by).alias("excluded")).agg(F.count(F.lit(1)).alias("population"), count(sampled).alias("sampled"), count(sampled & relevant).alias("relevant"))


METRICS = ["identified", "duplicates", "screened", "undecided", "excluded_title", "assessed", "excluded_full", "included"]


def flow(records: DataFrame, decisions: DataFrame, ref: str, report: str) -> DataFrame:
    """(metric, n, members_hash): the counts of a screening flow, from one labelled long table.

    members_hash is an order-free digest (sum of the refs' hashes) that ties a count to its members
    without collecting them.
    """
    own = records.groupBy(report).agg(F.min(ref).alias(ref), F.count(F.lit(1)).alias("copies")).join(decisions, ref, "left")
    title, full = F.col("title_outcome"), F.col("full_outcome")
    labels = F.array_compact(
        F.array(
            F.lit("screened"),
            F.when(title.isNull(), "undecided"),
            F.when(title == "exclude", "excluded_title"),
            F.when(title == "include", "assessed"),
            F.when((title == "include") & (full == "exclude"), "excluded_full"),
            F.when((title == "include") & (full == "include"), "included"),
        )
    )
    h = F.xxhash64(F.col(ref).cast("string")).cast("decimal(38,0)")
    rows = own.select(F.explode(labels).alias("metric"), F.lit(1).cast("long").alias("c"), h.alias("h"))
    rows = rows.union(own.select(F.lit("identified"), F.col("copies"), h)).union(own.select(F.lit("duplicates"), F.col("copies") - 1, h))
    zero = records.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, METRICS))).alias("metric"), F.lit(0).cast("long").alias("c"), F.lit(0).cast("decimal(38,0)").alias("h"))
    return rows.union(zero).groupBy("metric").agg(F.sum("c").alias("n"), F.sum("h").alias("members_hash"))


CHECKS = {
    "identified = duplicates + screened": ("identified", ["duplicates", "screened"]),
    "screened = undecided + excluded + assessed": ("screened", ["undecided", "excluded_title", "assessed"]),
    "assessed >= excluded + included": ("assessed", ["excluded_full", "included"]),
}


def flow_checks(flow_: DataFrame) -> DataFrame:
    """(check, expected, actual, ok) of the balance equations."""
    wide = flow_.groupBy().agg(*(F.max(F.when(F.col("metric") == m, F.col("n"))).alias(m) for m in METRICS))
    rows = [F.struct(F.lit(name).alias("check"), F.col(left).alias("expected"), sum((F.col(p) for p in parts), F.lit(0)).alias("actual"), ((F.col(left) >= sum((F.col(p) for p in parts), F.lit(0))) if ">=" in name else (F.col(left) == sum((F.col(p) for p in parts), F.lit(0)))).alias("ok")) for name, (left, parts) in CHECKS.items()]
    return wide.select(F.inline(F.array(*rows)))


def merge_sources(base: DataFrame, sources: list[tuple[str, DataFrame]], key: str, fields: list[str], check: str, base_name: str) -> DataFrame:
    """Fields from the first source that has them, with where they came from; a source whose `check` conflicts is refused."""
    out = base
    for name, source in sources:
        own = source.select(key, *(F.col(f).alias(f"_{name}_{f}") for f in fields), F.col(check).alias(f"_{name}_check"))
        out = out.join(own, key, "left")
    for f in fields:
        usable = [(name, F.when(F.col(f"_{name}_check").isNull() | F.col(check).isNull() | (F.col(f"_{name}_check") == F.col(check)), F.col(f"_{name}_{f}"))) for name, _ in sources]
        origin = F.coalesce(*[F.when(c.isNotNull(), F.lit(name)) for name, c in usable], F.when(F.col(f).isNotNull(), F.lit(base_name)))
        out = out.withColumn(f"{f}_from", origin).withColumn(f, F.coalesce(*[c for _, c in usable], F.col(f)))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def update_diff(before: DataFrame, after: DataFrame, key: str, content: str) -> DataFrame:
    """An update search against the one before: new, gone, changed or same, by content hash."""
    a = before.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("_a"))
    b = after.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("_b"))
    kind = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "gone").when(F.col("_a") != F.col("_b"), "changed").otherwise("same")
    return a.join(b, key, "full_outer").select(key, kind.alias("kind"))
