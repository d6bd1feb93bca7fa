"""Report and progress views: representatives, reasons, searches, retrieval, acquisition, stage metrics, imports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _count(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def representatives(records: DataFrame) -> DataFrame:
    """The record of each report: longest abstract, then earliest event, then first place."""
    rank = F.struct((-F.length(F.coalesce("abstract", F.lit("")))).alias("n"), "event_seq", "ordinal")
    row = F.struct(*records.columns)
    return records.groupBy("report_id").agg(F.min_by(row, rank).alias("r")).select("r.*")


def registry_reports(records: DataFrame) -> DataFrame:
    """Reports without any DOI whose records come from registries: (report_id, registry_only, all_from_registry)."""
    like = F.coalesce(F.col("journal").rlike(r"(?i)clinicaltrials\.gov|eudract|ctis|drks|isrctn"), F.lit(False))
    known = F.size(F.coalesce("registry_ids", F.array().cast("array<string>"))) > 0
    return records.groupBy("report_id").agg((~F.bool_or(F.col("doi").isNotNull()) & F.bool_or(known | like)).alias("registry_only"), F.bool_and(F.coalesce(F.col("from_registry"), F.lit(False))).alias("all_from_registry"))


def exclusion_reasons(criteria: DataFrame) -> DataFrame:
    """(criterion, label): short label, or the text, with a number that stays for good."""
    return criteria.select("criterion", F.concat(F.lit("E"), (F.col("position") + 1).cast("string"), F.lit(": "), F.coalesce("short_label", F.substring("text", 1, 80))).alias("label"))


def search_rows(searches: DataFrame, sources: DataFrame) -> DataFrame:
    """Searches numbered by time, with the source they used."""
    number = F.row_number().over(Window.partitionBy("topic").orderBy("started_at", "search_id"))
    return searches.withColumn("number", number).join(sources.select("source_id", "name", "platform"), "source_id", "left")


def sought(reports: DataFrame, decisions: DataFrame, documents: DataFrame, attempts: DataFrame, retry: list[str]) -> DataFrame:
    """Reports to retrieve: included on title, no document yet, never tried or last failed in a way that a new try may mend."""
    wanted = decisions.where("stage = 'title' and outcome = 'include'").select("report_id").distinct()
    last = attempts.groupBy("report_id").agg(F.max_by("kind", F.struct("at", "attempt_id")).alias("last"))
    own = reports.join(wanted, "report_id", "left_semi").join(documents.select("report_id").distinct(), "report_id", "left_anti")
    return own.join(last, "report_id", "left").where(F.col("last").isNull() | F.col("last").isin(retry))


def acquisition(responses: DataFrame) -> DataFrame:
    """What became of each fetched location, and the first acquired one of a report by rank."""
    kind = (
        F.when(F.col("status").isNull(), "unavailable")
        .when((F.col("status") < 200) | (F.col("status") >= 300), "http_error")
        .when(F.coalesce(~F.col("content_type").contains("pdf"), F.lit(True)), "not_pdf")
        .when(F.coalesce(F.col("refused"), F.lit(False)) | (F.coalesce(F.col("match"), F.lit("")) == "mismatch"), "wrong_document")
        .when(F.coalesce(F.col("pages"), F.lit(0)) == 0, "unreadable_pdf")
        .otherwise("acquired")
    )
    own = responses.withColumn("outcome", kind)
    first = own.where("outcome = 'acquired'").groupBy("report_id").agg(F.min("rank").alias("_first"))
    return own.join(first, "report_id", "left").withColumn("used", F.coalesce(F.col("rank") == F.col("_first"), F.lit(False))).drop("_first")


#: Places of a full text, best first; XML before PDF within one.
WATERFALL = ["publisher", "pmc", "repository", "preprint"]


def waterfall(locations: DataFrame, day: str) -> DataFrame:
    """Open locations of each report by source, XML before PDF, in input order; licences must have begun."""
    source = F.array_position(F.array(*map(F.lit, WATERFALL)), F.col("source"))
    order = Window.partitionBy("report_id").orderBy(F.when(source > 0, source).otherwise(99), F.when(F.col("format") == "xml", 0).otherwise(1), "input_pos")
    open_ = F.col("licence_start").isNull() | (F.col("licence_start") <= F.lit(day).cast("date"))
    return locations.where(open_).withColumn("rank", F.row_number().over(order))


def stage_metrics(items: DataFrame) -> DataFrame:
    """One row a stage from item flags: screened, remaining, conflicts, reveals, revised, sentinel accuracy."""
    sentinel = F.col("sentinel").isNotNull() & F.col("outcome").isNotNull()
    return items.groupBy("stage").agg(
        _count(F.col("outcome").isNotNull()).alias("screened"),
        _count(F.col("outcome").isNull()).alias("remaining"),
        _count(F.col("conflict")).alias("conflicts"),
        _count(F.col("revealed")).alias("reveals"),
        _count(F.col("revealed") & (F.col("provisional") != F.col("outcome"))).alias("revised"),
        F.try_divide(_count(sentinel & (F.col("sentinel") == F.col("outcome"))), _count(sentinel)).alias("sentinel_accuracy"),
    )


def reading_versions(readings: DataFrame) -> DataFrame:
    """(protocol_hash, ever, current): items read under each protocol version, and still read so."""
    latest = readings.groupBy("item").agg(F.max_by("protocol_hash", "seq").alias("protocol_hash")).groupBy("protocol_hash").agg(F.count(F.lit(1)).alias("current"))
    return readings.groupBy("protocol_hash").agg(F.countDistinct("item").alias("ever")).join(latest, "protocol_hash", "left").fillna(0, ["current"])


def enrichment_run(attempts: DataFrame) -> DataFrame:
    """Per source: asked, answered, failed, and the last failure."""
    return attempts.groupBy("source").agg(F.count(F.lit(1)).alias("asked"), _count(F.col("ok")).alias("answered"), _count(~F.col("ok")).alias("failed"), F.max_by("message", F.when(~F.col("ok"), F.struct("at", "message"))).alias("last_failure"))


def bench_flips(current: DataFrame, draft: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Two readings of each item beside the human outcome: flips first, those against the human before others."""
    own = current.select("item", F.col("proposal").alias("before")).join(draft.select("item", F.col("proposal").alias("after")), "item").join(outcomes, "item", "left")
    own = own.withColumn("flips", F.col("before") != F.col("after")).withColumn("against_human", F.coalesce(F.col("after") != F.col("outcome"), F.lit(False)))
    return own.orderBy(F.col("flips").desc(), F.col("against_human").desc(), "item")


def progress(items: DataFrame, role: str) -> DataFrame:
    """Outcome counts; a reviewer sees own items only, the lead all."""
    own = items if role == "lead" else items.where(F.col("reviewer") == role)
    return own.groupBy(F.coalesce("outcome", F.lit("open")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def sheet_changes(rows: DataFrame, exported: DataFrame, current: DataFrame) -> DataFrame:
    """Edited spreadsheet rows against what was exported and what holds now: changed, unchanged, refused (stale or unknown)."""
    own = rows.join(exported.select("ref", F.col("decision").alias("was"), F.lit(True).alias("_e")), "ref", "left").join(current.select("ref", F.col("decision").alias("now")), "ref", "left")
    kind = F.when(F.col("_e").isNull(), "refused").when(F.col("decision").eqNullSafe(F.col("was")), "unchanged").when(~F.col("was").eqNullSafe(F.col("now")), "refused").otherwise("changed")
    return own.withColumn("kind", kind).drop("_e")


def preview_hash(changes: DataFrame) -> DataFrame:
    """A hash of the changes that must be the same when they are applied."""
    line = F.concat_ws("\x1f", "ref", F.coalesce("was", F.lit("")), F.coalesce("decision", F.lit("")))
    return changes.where("kind = 'changed'").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\x1e"), 256).alias("preview"))


def search_completeness(batches: DataFrame) -> DataFrame:
    """batches (search_id, batch, reported, skipped, ids array): each search's distinct records, the first of each id, and whether they and the skipped ones are all that was reported."""
    ids = batches.select("search_id", F.explode("ids").alias("id")).groupBy("search_id").agg(F.countDistinct("id").alias("records"))
    own = batches.groupBy("search_id").agg(F.max("reported").alias("reported"), F.sum("skipped").alias("skipped")).join(ids, "search_id", "left").fillna(0, ["records"])
    return own.withColumn("complete", F.col("records") + F.col("skipped") == F.col("reported"))


#: What an event says, by its type: texts, and the payload's members in braces; {actor} is the actor's name.
SAID = {
    "screening.decided": "{actor} decided {item}: {outcome}",
    "screening.undone": "{actor} took back the decision on {item}",
    "screening.adjudicated": "{actor} ruled {outcome} on {item}",
    "corpus.merged": "{actor} joined {left} and {right}",
    "protocol.approved": "{actor} approved version {version}",
}


def described(events: DataFrame, names: DataFrame, said: dict[str, str] = SAID) -> DataFrame:
    """events (seq, type, actor_id, payload) as sentences; unknown types show their type, unknown actors their id, missing members a dash."""
    own = events.join(names.select("actor_id", "name"), "actor_id", "left")
    text = F.col("type")
    for kind, template in said.items():
        parts = re.split(r"\{(\w+)\}", template)
        value = lambda m: F.coalesce(F.coalesce("name", F.col("actor_id").cast("string")) if m == "actor" else F.get_json_object("payload", f"$.{m}"), F.lit("-"))
        text = F.when(F.col("type") == kind, F.concat(*[value(p) if i % 2 else F.lit(p) for i, p in enumerate(parts)])).otherwise(text)
    return own.select("seq", text.alias("said"))


def rejudge_problems(diff: DataFrame, allowed: list[str]) -> DataFrame:
    """Changes of a topic (path, kind) that a second reading of the same items may not have."""
    ok = F.lit(False)
    for prefix in allowed:
        ok = ok | F.col("path").startswith(prefix)
    return diff.where(~ok)


def stop_status(items: DataFrame, least_share: Column) -> DataFrame:
    """Per stage: the decided prefix in rank order, its relevant records, whether conflicts or too small a share withhold the test."""
    first = items.groupBy("stage").agg(F.min(F.when(F.col("outcome").isNull(), F.col("rank"))).alias("_u"), F.count(F.lit(1)).alias("n"))
    own = items.join(first, "stage")
    inside = F.col("_u").isNull() | (F.col("rank") < F.col("_u"))
    out = own.groupBy("stage", "n").agg(_count(inside).alias("screened"), _count(inside & (F.col("outcome") == "include")).alias("relevant"), _count(F.col("conflict")).alias("conflicts"))
    return out.withColumn("withheld", F.when(F.col("conflicts") > 0, "conflicts").when(F.col("screened") < least_share * F.col("n"), "too_few"))


def spelled_authors(spellings: DataFrame, fold) -> DataFrame:
    """(report_id, authors): the spelling with the most letters beyond ASCII among those equal without accents."""
    own = spellings.withColumn("text", F.array_join("authors", ";"))
    own = own.withColumn("folded", fold("text")).withColumn("marks", F.length(F.regexp_replace("text", r"[\x00-\x7F]", "")))
    best = own.groupBy("report_id", "folded").agg(F.max_by("authors", F.struct("marks", F.col("text"))).alias("authors"), F.min("input_pos").alias("p"))
    return best.groupBy("report_id").agg(F.min_by("authors", "p").alias("authors"))
