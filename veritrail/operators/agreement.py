"""Agreement and screening-accuracy aggregates: partial and final hash aggregates over pairs of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cohen(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """n, agreement, kappa (null if chance agreement is 1), pabak of two label columns.

    Rows in which either label is null don't count.
    """
    by = by or []
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count(F.lit(1)).alias("c"))
    side = cells.select(*by, F.col("x").alias("label"), F.col("c").alias("ca"), F.lit(0).alias("cb")).union(cells.select(*by, F.col("y"), F.lit(0), F.col("c")))
    label = side.groupBy(*by, "label").agg(F.sum("ca").alias("ca"), F.sum("cb").alias("cb"))
    chance = label.groupBy(*by).agg(F.sum(F.col("ca") * F.col("cb")).alias("products"))
    seen = cells.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("c")).otherwise(0)).alias("same"))
    both = seen.join(chance, by) if by else seen.join(chance)
    po, pe = F.col("same") / F.col("n"), F.col("products") / (F.col("n") * F.col("n"))
    return both.select(*by, "n", po.alias("agreement"), F.when(pe != 1, (po - pe) / (1 - pe)).alias("kappa"), (2 * po - 1).alias("pabak"))


def fleiss(ratings: DataFrame, item: str, label: str, min_raters: int = 2) -> DataFrame:
    """n_items, raters, kappa of (item, label) rows; null unless every item has the same raters, at least min_raters."""
    cells = ratings.groupBy(item, label).agg(F.count(F.lit(1)).alias("c"))
    items = cells.groupBy(item).agg(F.sum("c").alias("r"), F.sum(F.col("c") * (F.col("c") - 1)).alias("pairs"))
    total = items.agg(F.count(F.lit(1)).alias("n_items"), F.min("r").alias("lo"), F.max("r").alias("hi"), F.sum("pairs").alias("pairs"))
    share = cells.groupBy(label).agg(F.sum("c").alias("c")).agg(F.sum(F.col("c") * F.col("c")).alias("squares"))
    one = total.join(share)
    n, r = F.col("n_items"), F.col("lo")
    p, e = F.col("pairs") / (n * r * (r - 1)), F.col("squares") / (n * n * r * r)
    defined = (F.col("lo") == F.col("hi")) & (r >= min_raters) & (e != 1)
    return one.select("n_items", r.alias("raters"), F.when(defined, (p - e) / (1 - e)).alias("kappa"))


def rater_pairs(readings: DataFrame, item: str, rater: str, label: str) -> DataFrame:
    """For every two raters: n, the 2 x 2 table of a 0/1 label, kappa and pabak.

    Readings of one item meet in one small array, so items are shuffled once and no pair of
    raters is joined against all rows.
    """
    own = readings.groupBy(item).agg(F.array_sort(F.collect_list(F.struct(F.col(rater).alias("rater"), F.col(label).alias("label")))).alias("all"))
    left = own.select(item, "all", F.posexplode("all").alias("i", "l"))
    pairs = left.select(F.col("l.rater").alias("rater_a"), F.col("l.label").alias("a"), F.explode(F.slice("all", F.col("i") + 2, F.greatest(F.size("all") - F.col("i") - 1, F.lit(0)))).alias("r"))
    pairs = pairs.select("rater_a", F.col("r.rater").alias("rater_b"), "a", F.col("r.label").alias("b"))
    cell = lambda x, y: F.sum(F.when((F.col("a") == x) & (F.col("b") == y), 1).otherwise(0))
    t = pairs.groupBy("rater_a", "rater_b").agg(F.count(F.lit(1)).alias("n"), cell(1, 1).alias("both_yes"), cell(1, 0).alias("a_only"), cell(0, 1).alias("b_only"), cell(0, 0).alias("both_no"))
    po = (F.col("both_yes") + F.col("both_no")) / F.col("n")
    yes = (F.col("both_yes") + F.col("a_only")) * (F.col("both_yes") + F.col("b_only"))
    no = (F.col("both_no") + F.col("a_only")) * (F.col("both_no") + F.col("b_only"))
    pe = (yes + no) / (F.col("n") * F.col("n"))
    return t.select("*", F.when(pe != 1, (po - pe) / (1 - pe)).alias("kappa"), (2 * po - 1).alias("pabak"))


def kappa_flag(n: Column, kappa: Column) -> Column:
    """How to read a kappa: suppressed under 10 items, below chance, low under 0.4, else shown."""
    return F.when(n < 10, "suppressed").when(kappa < 0, "below_chance").when(kappa < 0.4, "low").otherwise("shown")


def confusion(df: DataFrame, relevant: Column, excluded: Column) -> DataFrame:
    """tp, fn, tn, fp, recall, specificity, work_saved, wss of an exclusion rule against a gold label."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    t = df.select(relevant.alias("rel"), excluded.alias("exc")).agg(
        count(F.col("rel") & ~F.col("exc")).alias("tp"),
        count(F.col("rel") & F.col("exc")).alias("fn"),
        count(~F.col("rel") & F.col("exc")).alias("tn"),
        count(~F.col("rel") & ~F.col("exc")).alias("fp"),
    )
    n = F.col("tp") + F.col("fn") + F.col("tn") + F.col("fp")
    recall = F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    saved = F.try_divide(F.col("tn") + F.col("fn"), n)
    return t.select("*", recall.alias("recall"), F.try_divide(F.col("tn"), F.col("tn") + F.col("fp")).alias("specificity"), saved.alias("work_saved"), (saved - (1 - recall)).alias("wss"))


def judge_pair(df: DataFrame, relevant: Column, a: Column, b: Column) -> DataFrame:
    """Two exclusion rules at once: the rule that excludes only if both do, both-wrong rate, agreement."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    t = df.select(relevant.alias("rel"), a.alias("a"), b.alias("b")).agg(
        F.count(F.lit(1)).alias("n"),
        count(F.col("rel") & ~(F.col("a") & F.col("b"))).alias("or_tp"),
        count(F.col("rel") & F.col("a") & F.col("b")).alias("or_fn"),
        count(~F.col("rel") & F.col("a") & F.col("b")).alias("or_tn"),
        count((F.col("a") == F.col("rel")) & (F.col("b") == F.col("rel"))).alias("both_wrong"),
        count(F.col("a") == F.col("b")).alias("same"),
    )
    return t.select("*", F.try_divide(F.col("or_tp"), F.col("or_tp") + F.col("or_fn")).alias("or_recall"), F.try_divide(F.col("both_wrong"), F.col("n")).alias("double_fault"), F.try_divide(F.col("same"), F.col("n")).alias("agreement"))


def identification_counts(records: DataFrame, source: str, report: str) -> DataFrame:
    """records, unique reports and duplicates per source (null: unknown), exact."""
    return records.groupBy(F.coalesce(F.col(source), F.lit("unknown")).alias("source")).agg(
        F.count(F.lit(1)).alias("records"), F.countDistinct(report).alias("unique_reports"), (F.count(F.lit(1)) - F.countDistinct(report)).alias("duplicates")
    )


def source_cells(hits: DataFrame, report: str, source: str) -> DataFrame:
    """Reports per set of sources that found them: the cells of a capture-recapture estimate."""
    return hits.groupBy(report).agg(F.array_join(F.array_sort(F.collect_set(source)), "+").alias("sources")).groupBy("sources").agg(F.count(F.lit(1)).alias("n"))


def set_hash(df: DataFrame, ref: str, by: list[str] | None = None) -> DataFrame:
    """A hash of the set of refs of each group, whatever their order: SHA-256 of their sorted JSON list.

    A hash is made in one go by its nature, but no list is: refs are sorted by Spark, and one hasher a group takes them batch by batch.
    """
    import hashlib

    import pyarrow as pa

    by = by or []
    kinds = dict(df.dtypes)
    refs = df.where(F.col(ref).isNotNull()).select(*by, F.col(ref).cast("string").alias("_ref")).distinct()
    groups = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    dealt = (refs.repartition(*by) if by else refs.repartition(1)).sortWithinPartitions(*by, "_ref")

    def run(batches):
        own = hasher = None
        done: list[tuple] = []
        for batch in batches:
            keys = list(zip(*(batch[c].to_pylist() for c in by))) if by else [()] * batch.num_rows
            types = [batch.schema.field(c).type for c in by] + [pa.string()]
            values = batch["_ref"].to_pylist()
            at = 0
            while at < len(keys):
                upto = at
                while upto < len(keys) and keys[upto] == keys[at]:
                    upto += 1
                if hasher is None or keys[at] != own:
                    if hasher is not None:
                        hasher.update(b"]")
                        done.append((*own, hasher.hexdigest()))
                    own, hasher, sign = keys[at], hashlib.sha256(b"["), ""
                hasher.update((sign + ",".join(f'"{v}"' for v in values[at:upto])).encode())
                sign, at = ",", upto
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), types)], names=[*by, "set_hash"])
                done = []
        if hasher is not None:
            hasher.update(b"]")
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*own, hasher.hexdigest()), types)], names=[*by, "set_hash"])

    found = dealt.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "set_hash string"]))
    empty = hashlib.sha256(b"[]").hexdigest()
    if not by:
        return found.unionByName(groups.select(F.lit(empty).alias("set_hash"))).agg(F.coalesce(F.max(F.when(F.col("set_hash") != empty, F.col("set_hash"))), F.lit(empty)).alias("set_hash"))
    same = None
    for c in by:
        same = F.col(f"g.{c}").eqNullSafe(F.col(f"h.{c}")) if same is None else same & F.col(f"g.{c}").eqNullSafe(F.col(f"h.{c}"))
    return groups.alias("g").join(found.alias("h"), same, "left").select(*(F.col(f"g.{c}") for c in by), F.coalesce("h.set_hash", F.lit(empty)).alias("set_hash"))


def best_record(records: DataFrame, report: str, order: list[str], text: str, firsts: list[str], unions: list[str]) -> DataFrame:
    """One record per report: the longest text, the first non-null of `firsts`, ordered distinct unions of arrays."""
    place = F.struct(*order)
    keep_first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c)
    union = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("o"), F.coalesce(F.col(c), F.array()).alias("v")))), lambda s: s["v"]))).alias(c)
    longest = F.struct(F.length(F.coalesce(F.col(text), F.lit(""))).alias("n"), *[(-F.col(o)).alias(o) for o in order])
    return records.groupBy(report).agg(F.max_by(text, longest).alias(text), *(keep_first(c) for c in firsts), *(union(c) for c in unions))
