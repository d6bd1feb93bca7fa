"""Ledger events in words: a kind, a sentence and facts for each event type, from a table of wordings.

A wording is text with members of the event's payload in braces: {member} as it stands, {@member} as the name of the id it holds,
{#member} as the number of elements of a list, {actor} the name of who acted. Of the wordings of a type the first whose condition holds counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: type, condition (a member and its value; a value of None: it isn't there, "*": it is), kind, sentence, facts (label: member)
WORDINGS: list[tuple[str, tuple[str, str | None] | None, str, str, dict[str, str]]] = [
    ("search.executed", None, "search", "{actor} ran a search of {source}: {retrieved_count} records", {"Query": "strategy", "Begun": "started_at", "Ended": "ended_at", "Reported": "reported_count", "Retrieved": "retrieved_count"}),
    ("corpus.ingested", None, "identity", "{actor} made a corpus of {occurrences} search results, with {proposals} proposed links", {"Identity revision": "identity_revision_id"}),
    ("corpus.pool_imported", None, "identity", "{actor} gave {entries} known papers for topic {topic_id}", {"File": "file_name", "Format": "format"}),
    ("corpus.pool_withdrawn", None, "identity", "{actor} withdrew {entries} known papers of topic {topic_id}", {}),
    ("corpus.confirmed", None, "identity", "{actor} confirmed that {#occurrence_ids} search results are {relation}", {"Reason": "reason", "Identity revision": "revision_id", "Before": "parent_revision_id"}),
    ("corpus.merged", None, "identity", "{actor} joined {#occurrence_ids} search results as {relation}", {"Reason": "reason", "Identity revision": "revision_id", "Before": "parent_revision_id"}),
    ("corpus.split", None, "identity", "{actor} parted {#occurrence_ids} search results", {"Reason": "reason", "Identity revision": "revision_id", "Before": "parent_revision_id"}),
    ("screening.stage_opened", None, "stage", "{actor} opened a {stage} stage of scope {scope_id}", {"Mode": "mode", "Documentation": "documentation", "Reveal": "reveal", "Records": "records"}),
    ("screening.judging_requested", None, "ai", "{actor} had {items} records put to the model", {"Configuration": "judge_config_id"}),
    ("judge.verdict_recorded", ("excludes", "true"), "ai", "The model proposed an exclusion", {"Verdict": "verdict_id"}),
    ("judge.verdict_recorded", None, "ai", "The model proposed no exclusion", {"Verdict": "verdict_id"}),
    ("screening.ai_read", None, "ai", "The model read {#readings} records", {"Stage": "stage_id"}),
    ("screening.decided", ("origin", "bulk"), "decision", "{actor} decided {@item_ref} with others: {outcome}", {"Criterion": "reason_criterion_id", "Phase": "phase"}),
    ("screening.decided", ("origin", "spreadsheet"), "decision", "{actor} decided {@item_ref} in a spreadsheet: {outcome}", {"Criterion": "reason_criterion_id", "Phase": "phase"}),
    ("screening.decided", ("second_opinion", "true"), "decision", "{actor} decided {@item_ref} and asked for a second opinion: {outcome}", {"Criterion": "reason_criterion_id"}),
    ("screening.decided", ("phase", "provisional"), "decision", "{actor} decided {@item_ref} before seeing the model's reading: {outcome}", {"Criterion": "reason_criterion_id", "Settled": "settled"}),
    ("screening.decided", None, "decision", "{actor} decided {@item_ref} for good: {outcome}", {"Criterion": "reason_criterion_id"}),
    ("screening.undone", None, "decision", "{actor} took back the decision on {@item_ref}", {"Decision": "decision_id"}),
    ("screening.second_opinion_requested", None, "decision", "{@reviewer_id} was drawn for a second opinion on {@item_ref}", {"Decision": "decision_id"}),
    ("screening.bulk_decided", None, "decision", "{actor} decided {items} records at once: {outcome}", {"Criterion": "reason_criterion_id"}),
    ("screening.spreadsheet_imported", None, "decision", "{actor} took in a spreadsheet: {changed} decisions changed", {"File": "file_name", "Refused": "refused"}),
    ("screening.rejudged", None, "stage", "{actor} had {items} records read again, {strictness}", {"From": "from_protocol_hash", "To": "to_protocol_hash"}),
    ("screening.bench_requested", None, "ai", "{actor} had a draft of the instructions tried on {items} records", {}),
    ("screening.bench_finished", None, "ai", "The trial of the draft ended: {flips} readings differ", {}),
    ("screening.item_withdrawn", None, "stage", "{@item_ref} was withdrawn from the stage", {"Reason": "reason"}),
    ("screening.ai_disagreement_rescreen", ("new_assignment", "true"), "decision", "{@auditor_id} screens {@item_ref} once more, without the model", {"Reason": "reason"}),
    ("screening.ai_disagreement_rescreen", None, "decision", "The audit of {@item_ref} stands for the extra screen", {"Reason": "reason"}),
    ("screening.adjudicated", None, "decision", "{actor} ruled on {@item_ref}: {outcome}", {"Reason": "reason"}),
    ("project.full_text_attached", ("acquisition_id", "*"), "document", "A fetched full text was attached to {@item_ref}", {"Acquisition": "acquisition_id"}),
    ("project.full_text_attached", None, "document", "{actor} attached a full text to {@item_ref}", {"Document": "document_id"}),
    ("project.full_text_detached", None, "document", "{actor} detached the full text of {@item_ref}", {"Reason": "reason"}),
    ("document.acquired", None, "document", "A full text of {@report_id} was fetched", {"Address": "url", "Source": "source"}),
    ("document.acquisition_failed", None, "document", "No full text of {@report_id} could be fetched", {"Outcome": "outcome"}),
    ("document.acquisition_attempted", None, "document", "A location of {@report_id} was tried: {outcome}", {"Address": "url"}),
    ("retrieval.open_access_requested", None, "retrieval", "{actor} had full texts of {#report_ids} reports looked for", {}),
    ("retrieval.no_open_access_location", None, "retrieval", "No open place of {@report_id} is known", {}),
    ("retrieval.source_asked", ("failure", "*"), "retrieval", "{source} gave no answer for {@report_id}", {"Failure": "failure"}),
    ("retrieval.source_asked", None, "retrieval", "{source} named {locations} places of {@report_id}", {}),
    ("retrieval.open_access_finished", None, "retrieval", "The search for full texts ended with {acquired} found", {"Not found": "missing"}),
    ("retrieval.retry_requested", None, "retrieval", "{actor} had {#report_ids} reports tried again", {}),
    ("retrieval.upload_matched", None, "retrieval", "An upload was matched to {@report_id} by its {matched_by}", {"File": "file_name"}),
    ("retrieval.upload_held", None, "retrieval", "An upload waits to be assigned", {"File": "file_name"}),
    ("retrieval.upload_assigned", None, "retrieval", "{actor} assigned an upload to {@report_id}", {"File": "file_name"}),
    ("retrieval.upload_discarded", None, "retrieval", "{actor} discarded an upload", {"File": "file_name"}),
    ("enrichment.requested", ("trigger", "retry"), "enrichment", "{actor} had failed sources asked again", {}),
    ("enrichment.requested", None, "enrichment", "{actor} had records enriched", {}),
    ("enrichment.records_enriched", None, "enrichment", "{source} told more of {#report_ids} records", {}),
    ("enrichment.finished", None, "enrichment", "The enrichment ended: {answered} answers, {failed} failures", {}),
    ("extraction.run_requested", None, "extraction", "{actor} had values of {@report_id} extracted", {"Schema": "schema_hash"}),
    ("extraction.proposals_recorded", None, "extraction", "{#proposals} values were proposed by {path}", {"Run": "run_id"}),
    ("extraction.value_accepted", None, "extraction", "{actor} accepted {value} for {field}", {"Anchor": "anchor_id"}),
    ("appraisal.started", None, "appraisal", "{actor} began to appraise {@report_id}", {"Tool": "tool"}),
    ("appraisal.answered", None, "appraisal", "{actor} answered {question}: {answer}", {}),
    ("appraisal.overridden", ("target", "overall"), "appraisal", "{actor} set the overall judgement to {judgement}", {"Reason": "reason"}),
    ("appraisal.overridden", None, "appraisal", "{actor} set the judgement of {target} to {judgement}", {"Reason": "reason"}),
    ("report.rendered", None, "report", "{actor} had the report made", {"Hash": "report_hash"}),
    ("report.working_exported", None, "report", "{actor} exported working sheets", {"Hash": "file_hash"}),
    ("ledger.bundle_sealed", None, "report", "{actor} sealed a bundle at event {head_seq}", {"Hash": "bundle_hash"}),
    ("protocol.published", None, "protocol", "{actor} published version {version} of the protocol", {"Hash": "content_hash"}),
    ("protocol.assist", None, "protocol", "{actor} had the assistant help: {purpose}", {}),
    ("project.member_added", None, "project", "{actor} made {@member_id} a {role}", {}),
]


def _parts(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\{[@#]?[a-z_]+\}|[^{}]+"), F.lit(0))


def in_words(events: DataFrame, names: DataFrame, wordings: list[tuple] = WORDINGS) -> DataFrame:
    """(project_id, seq, type, kind, said, facts) of events (project_id, seq, type, actor_id, payload); names: id, name of people and records.

    facts: array of struct(label, value), without those that the payload lacks. Unknown types are of kind project and say their type; an unknown
    id stands for itself, a missing member is a dash. Wordings are a fixed table, broadcast; names are joined.
    """
    spark = events.sparkSession
    rows = [(i, t, *(on or (None, None)), on is not None, kind, said, list(facts.items())) for i, (t, on, kind, said, facts) in enumerate(wordings)]
    table = spark.createDataFrame(rows, "n int, type string, member string, wanted string, conditional boolean, kind string, sentence string, facts array<struct<label: string, member: string>>")
    own = events.select("project_id", "seq", "type", F.col("actor_id").cast("string").alias("actor_id"), F.from_json("payload", "map<string, string>").alias("p"), F.col("payload"))
    found = F.try_element_at("p", F.col("member"))
    holds = ~F.col("conditional") | F.when(F.col("wanted").isNull(), found.isNull()).when(F.col("wanted") == "*", found.isNotNull()).otherwise(found.eqNullSafe(F.col("wanted")))
    fits = own.join(F.broadcast(table), "type").where(holds).groupBy("project_id", "seq").agg(F.min_by(F.struct("kind", "sentence", "facts"), "n").alias("w"))
    own = own.join(fits, ["project_id", "seq"], "left")
    parts = own.select("project_id", "seq", "actor_id", "p", F.posexplode(_parts(F.col("w.sentence"))).alias("i", "part"))
    mark, member = F.substring("part", 2, 1), F.regexp_extract("part", r"^\{[@#]?([a-z_]+)\}$", 1)
    value = F.when(member == "actor", F.col("actor_id")).otherwise(F.try_element_at("p", member))
    length = F.size(F.from_json(value, "array<string>"))
    parts = parts.select("project_id", "seq", "i", "part", (member != "").alias("filled"), F.when((mark == "@") | (member == "actor"), value).alias("id"), F.when(mark == "#", length.cast("string")).otherwise(value).alias("value"))
    named = parts.join(names.select(F.col("id").cast("string").alias("id"), "name"), "id", "left")
    shown = F.when(F.col("filled"), F.coalesce("name", "value", F.lit("-"))).otherwise(F.col("part"))
    said = named.groupBy("project_id", "seq").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", shown.alias("t")))), lambda x: x["t"]), "").alias("said"))
    facts = F.filter(F.transform(F.col("w.facts"), lambda f: F.struct(f["label"].alias("label"), F.try_element_at("p", f["member"]).alias("value"))), lambda f: f["value"].isNotNull())
    none = F.array().cast("array<struct<label: string, value: string>>")
    return own.join(said, ["project_id", "seq"], "left").select("project_id", "seq", "type", F.coalesce("w.kind", F.lit("project")).alias("kind"), F.coalesce("said", "type").alias("said"), F.coalesce(facts, none).alias("facts"))
