"""Mixing to target weights: soft domain membership and projected-gradient least squares.

A naive Bayes over telling words learns the domains `high`, `low` and `toxic` from the labels
table and gives every document a posterior over them: a domain's telling words stand in
`least` of its texts and in `support` of them at least, and more than `lift` times as often as
in the others (both shares with `smooth` added to the counts of texts with and without the
word); none of this asks for more labels. Each one present adds its log likelihood ratio, and their absence as a whole counts as one more feature. Rates r >= 0 of documents
then minimise the squared gaps, relative to a domain's size, between the expected domain
totals sum(r * tokens * posterior) and their targets, by gradient steps followed by the
projection max(0, .). A step needs one sum per domain over all documents; a document's rate
follows from the steps so far, so nothing is stored between steps but those few numbers.
All of it is built-in functions.

Bounds, as parameters: the classifier is fitted on at most about `sample` labelled documents
of each domain (chosen by hash) and keeps the `features` words that tell each domain best
(by the z of its share against the others').
Scores, totals and rates cover all documents.

Defined cases: a null text has no tokens and the posterior of a text without known words; a
null doc_id is scored like any other; repeated rows count as often as they stand; without
labels the posterior is even; labels with nulls are left out; a domain that no
document belongs to can't be reached and keeps its gap; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import materialize, table

DOMAINS = ("high", "low", "toxic")
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(TOKEN), F.lit(0))


def domain_of() -> Column:
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").otherwise("low")


def fit(docs: DataFrame, labels: DataFrame, sample: int, features: int, lift: float = 20.0, support: float = 0.02, least: int = 3, smooth: float = 0.5) -> tuple[dict[str, float], dict[str, float], dict[str, dict[str, float]]]:
    """Log prior of each domain, log ratio of having none of its words, weights of its words."""
    known = labels.where("quality is not null and toxic is not null and doc_id is not null")
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality")).withColumn("domain", domain_of())
    sizes = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}  # three rows
    even = {d: math.log(1 / len(DOMAINS)) for d in DOMAINS}, dict.fromkeys(DOMAINS, 0.0), {}
    if not sizes:
        return even
    share = F.coalesce(*[F.when(F.col("domain") == d, F.lit(min(1.0, sample / n))) for d, n in sizes.items()])
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000).select("doc_id", "domain")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # about `sample` rows of each domain at most
    own = materialize(own.dropDuplicates(["text"]).select("domain", F.array_distinct(tokens_of(F.col("text"))).alias("words")), "mixing-sample")
    total = {r["domain"]: r["n"] for r in own.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not total:
        return even
    every, labelled = sum(total.values()), sum(sizes.values())
    in_domain = {d: F.sum(F.when(F.col("domain") == d, 1).otherwise(0)).alias(d) for d in DOMAINS}
    wide = materialize(own.select("domain", F.explode("words").alias("word")).groupBy("word").agg(*in_domain.values()), "mixing-words")
    weights: dict[str, dict[str, float]] = {}
    for d in DOMAINS:
        n, rest = total.get(d, 0), every - total.get(d, 0)
        if not n or not rest:
            continue
        others = sum((F.col(o) for o in DOMAINS if o != d), F.lit(0))
        a, b, p = (F.col(d) + smooth) / (n + 2 * smooth), (others + smooth) / (rest + 2 * smooth), (F.col(d) + others) / every
        z = (a - b) / F.sqrt(p * (1 - p) * (1 / n + 1 / rest) + 1e-12)
        best = wide.select("word", d, z.alias("z"), F.log(a / b).alias("w")).where((F.col(d) >= max(least, support * n)) & (F.col("w") > math.log(lift)))
        for r in best.orderBy(F.col("z").desc(), "word").limit(features).collect():  # at most `features` rows
            weights.setdefault(r["word"], {})[d] = r["w"]
    prior = {d: math.log((sizes.get(d, 0) + 0.5) / (labelled + 1.5)) for d in DOMAINS}
    none = dict.fromkeys(DOMAINS, 0.0)
    for d in DOMAINS:
        told = [w for w, v in weights.items() if d in v]
        if told:
            row = own.where(~F.arrays_overlap("words", F.array(*map(F.lit, told)))).agg(*in_domain.values()).first()
            lacking = {o: row[o] or 0 for o in DOMAINS}
            n, rest = total.get(d, 0), every - total.get(d, 0)
            none[d] = math.log((lacking[d] + 0.5) / (n + 1)) - math.log((sum(lacking.values()) - lacking[d] + 0.5) / (rest + 1))
    return prior, none, weights


def posteriors(docs: DataFrame, prior: dict[str, float], none: dict[str, float], weights: dict[str, dict[str, float]]) -> DataFrame:
    """doc_id, _key, n_tokens, p_high, p_low, p_toxic of every row; _key names the text."""
    spark = docs.sparkSession
    key = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.xxhash64(F.col("text").cast("string")))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("_key"), tokens_of(F.col("text")).alias("tokens"))
    plain = {d: F.lit(prior[d]) for d in DOMAINS}
    if not weights:
        scored = own.select("doc_id", "_key", F.size("tokens").cast("long").alias("n_tokens"), *(plain[d].alias(d) for d in DOMAINS))
    else:
        # the list of known words is bounded: `features` for each domain
        listed_json = json.dumps([{"word": w, **{d: v.get(d, 0.0) for d in DOMAINS}} for w, v in weights.items()])
        fields = "array<struct<word string, " + ", ".join(f"{d} double" for d in DOMAINS) + ">>"
        known = spark.range(1).select(F.inline(F.from_json(F.lit(listed_json), fields)))
        listed = F.array(*[F.lit(w) for w in weights])
        held = materialize(own.select("doc_id", "_key", F.size("tokens").cast("long").alias("n_tokens"), F.array_intersect("tokens", listed).alias("words")), "mixing-held")
        found = held.select("_key", "words").where(F.size("words") > 0).groupBy("_key").agg(F.first("words").alias("words"))
        found = found.select("_key", F.explode("words").alias("word")).join(F.broadcast(known), "word")
        sums = materialize(found.groupBy("_key").agg(*(F.sum(d).alias(f"s_{d}") for d in DOMAINS)), "mixing-sums")
        scored = held.join(sums, "_key", "left").select("doc_id", "_key", "n_tokens", *((plain[d] + F.when(F.col(f"s_{d}") > 0, F.col(f"s_{d}")).otherwise(none[d])).alias(d) for d in DOMAINS))
    top = F.greatest(*DOMAINS)
    scored = scored.withColumns({f"e_{d}": F.exp(F.col(d) - top) for d in DOMAINS})
    norm = sum((F.col(f"e_{d}") for d in DOMAINS), F.lit(0.0))
    return scored.select("doc_id", "_key", "n_tokens", *((F.col(f"e_{d}") / norm).alias(f"p_{d}") for d in DOMAINS))


def rate_after(steps: list[list[float]]) -> Column:
    """The rate of a document after the given steps, from rate 1."""
    if not steps:
        return F.lit(1.0)
    history = F.array(*[F.array(*map(F.lit, s)) for s in steps])
    move = lambda s: sum((F.col(f"p_{d}") * s[i] for i, d in enumerate(DOMAINS)), F.lit(0.0))
    return F.aggregate(history, F.lit(1.0), lambda r, s: F.greatest(F.lit(0.0), r - move(s)))


def solve(scored: DataFrame, targets: dict[str, float], most_steps: int = 40, near: float = 1e-3) -> tuple[list[list[float]], dict[str, tuple[float, float]]]:
    """Steps of the projected gradient, and (target, reached) of each domain.

    targets are factors on the domains' own expected totals. A step is the gradient scaled by
    1 / tokens for a document and by the domain's size for a gap, so that a step of 1 is stable.
    """
    size = dict(scored.agg(*(F.coalesce(F.sum(F.col("n_tokens") * F.col(f"p_{d}")), F.lit(0.0)).alias(d) for d in DOMAINS)).first().asDict())
    goal = {d: size[d] * targets.get(d, 1.0) for d in DOMAINS}
    steps: list[list[float]] = []
    reached = dict(size)
    while len(steps) < most_steps and any(abs(reached[d] - goal[d]) > near * max(size[d], 1.0) for d in DOMAINS):
        steps.append([(reached[d] - goal[d]) / size[d] if size[d] > 0 else 0.0 for d in DOMAINS])
        mass = rate_after(steps) * F.col("n_tokens")
        reached = dict(scored.agg(*(F.coalesce(F.sum(mass * F.col(f"p_{d}")), F.lit(0.0)).alias(d) for d in DOMAINS)).first().asDict())
    return steps, {d: (goal[d], reached[d]) for d in DOMAINS}


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float], sample: int = 4000, features: int = 300, lift: float = 20.0, support: float = 0.02, least: int = 3, smooth: float = 0.5) -> DataFrame:
    """doc_id, _key, n_tokens, p_high, p_low, p_toxic, rate of every row of docs (doc_id, text)."""
    scored = materialize(posteriors(docs, *fit(docs, labels, sample, features, lift, support, least, smooth)), "mixing-scored")
    steps, _ = solve(scored, targets)
    return scored.withColumn("rate", rate_after(steps))


def mixed(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """The rows of docs, as often as their rates say: the whole part, and once more by a draw on the hash of id and text."""
    rates = rates.select(F.col("doc_id").alias("id"), F.col("_key").alias("of"), "rate").distinct()
    text = F.col("row.text")
    own = docs.select(F.struct("*").alias("row"))  # so that no column of docs can clash
    own = own.select("row", F.col("row.doc_id").cast("long").alias("own_id"), F.when(text.isNull(), F.lit(0)).otherwise(F.xxhash64(text.cast("string"))).alias("own_of"))
    met = own.join(rates, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_of") == F.col("of")))
    draw = F.pmod(F.xxhash64(F.lit(11), "own_id", "own_of"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    copies = (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")).cast("int")
    return met.withColumn("n", copies).where("n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")


#: Factors on the domains' expected tokens: more of the good, no less of the plain, nothing toxic.
TARGETS = {"high": 1.25, "low": 1.1, "toxic": 0.0}


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), TARGETS).drop("_key")
