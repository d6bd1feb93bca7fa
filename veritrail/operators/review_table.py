"""The screening table as its viewers may see it, the retrieval list, AI involvement, optional filters.

Items have item, kind, audit, rescreen, rank, title, withdrawn and criteria (the verified reading: array of
struct(id, status, verified, failed_check), null before the reading). Assignments have assignment, item,
reviewer, role, state, position, outcome, criterion and, for second opinions, consults.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.operators.folds import folded
from veritrail.operators.screening import excluding_criteria, proposal, verdict_excludes

#: Roles in the order in which the lead sees their decisions.
ROLES = ["screener", "second_opinion", "auditor"]


def optional(df: DataFrame, **filters) -> DataFrame:
    """Rows that fit the filters that are set: a value must be equal, a list holds it, None asks for nothing."""
    for column, wanted in filters.items():
        if wanted is not None:
            df = df.where(F.col(column).isin(wanted) if isinstance(wanted, (list, tuple, set)) else F.col(column) == F.lit(wanted))
    return df


def excluding_criterion(criteria: Column) -> Column:
    """The first criterion, in order, whose verified answer excludes."""
    return F.get(excluding_criteria(criteria), F.lit(0))["id"]


def with_status(criteria: Column, status: str) -> Column:
    return F.transform(F.filter(F.coalesce(criteria, F.array().cast("array<struct<id:string,status:string,verified:boolean,failed_check:string>>")), lambda c: c["status"] == status), lambda c: c["id"])


def reviewer_rows(items: DataFrame, assignments: DataFrame, viewer, shows_reading: bool = False) -> DataFrame:
    """A reviewer's own rows by queue position: the own decision, and the reading only where the stage shows it before.

    Others' decisions, the outcome, flags and the reading's rank stay hidden.
    """
    own = assignments.where(F.col("reviewer") == F.lit(viewer)).join(items.where("not withdrawn"), "item")
    shown = proposal(F.col("criteria"), F.lit(False), F.lit(False)) if shows_reading else F.lit(None).cast("struct<outcome:string,criterion:string>")
    shown = F.when(F.col("criteria").isNotNull(), shown)
    return own.select(F.col("assignment").cast("string").alias("ref"), "item", "position", "title", "state", "outcome", "criterion", shown["outcome"].alias("ai_outcome"))


def lead_rows(items: DataFrame, assignments: DataFrame, outcomes: DataFrame, rulings: DataFrame, working: bool = False) -> DataFrame:
    """Every item that isn't withdrawn: decisions, outcome with its reason, the reading and the flags.

    outcomes (item, record_outcome); rulings (item, seq, criterion) of resolved conflicts: the last one counts.
    An excluded record's reason is the ruling's criterion, else the second opinion's, else the screeners'.
    """
    order = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role"))
    seen = assignments.where("role <> 'second_opinion' or consults is not null")
    seen = seen.groupBy("item").agg(F.array_sort(F.collect_list(F.struct(order.alias("at"), "reviewer", "role", "state", "outcome", "criterion"))).alias("decisions"))
    ruled = rulings.groupBy("item").agg(F.max_by("criterion", "seq").alias("ruled"))
    rows = items.where("not withdrawn").join(seen, "item", "left").join(outcomes.select("item", "record_outcome"), "item", "left").join(ruled, "item", "left")
    made = lambda role: F.transform(F.filter("decisions", lambda d: (d["role"] == role) & (d["state"] == "decided")), lambda d: d["criterion"])
    second, screeners = made("second_opinion"), F.array_distinct(F.array_compact(made("screener")))
    reason = F.when(F.col("ruled").isNotNull(), F.col("ruled")).when(F.size(second) > 0, F.try_element_at(second, F.lit(-1))).when(F.size(screeners) > 0, F.array_join(screeners, ", "))
    said = F.when(F.col("criteria").isNotNull(), proposal(F.col("criteria"), F.lit(False), F.lit(working)))
    flags = F.array_compact(F.array(F.when(F.col("kind") == "sentinel", "sentinel"), F.when(F.col("audit"), "audit"), F.when(F.col("rescreen"), "rescreen")))
    return rows.select(
        "item", "title", F.coalesce(F.size("decisions"), F.lit(0)).alias("n_decisions"), F.col("record_outcome").alias("outcome"),
        F.when(F.col("record_outcome") == "exclude", reason).alias("outcome_reason"), F.when(F.col("criteria").isNotNull(), verdict_excludes(F.col("criteria"))).alias("ai_excludes"),
        with_status(F.col("criteria"), "not_met").alias("ai_not_met"), with_status(F.col("criteria"), "unclear").alias("ai_unclear"), said["outcome"].alias("ai_outcome"), flags.alias("flags"), "kind", "rank",
    )


def in_lead_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("kind", F.col("rank").asc_nulls_last(), "item")


def known_includes(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(known, read, proposed_exclude): how many rows are known includes, how many the reading covers and would exclude."""
    own = rows.join(known.select("item").distinct(), "item", "left_semi")
    return own.agg(F.count(F.lit(1)).alias("known"), F.count("ai_outcome").alias("read"), F.count_if(F.col("ai_outcome") == "exclude").alias("proposed_exclude"))


def ai_involvement(excluded: DataFrame) -> DataFrame:
    """(measure, n) over excluded items (item, ai_excludes, ai_revealed, ai_rescreened), each item once in the union."""
    kinds = {"excluded_with_ai_proposal": F.col("ai_excludes"), "excluded_after_ai_reveal": F.col("ai_revealed"), "excluded_after_ai_rescreen": F.col("ai_rescreened")}
    any_ = F.col("ai_excludes") | F.col("ai_revealed") | F.col("ai_rescreened")
    wide = excluded.agg(*(F.count_distinct(F.when(c, F.col("item"))).alias(k) for k, c in (kinds | {"excluded_with_ai_involvement": any_}).items()))
    return wide.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, wide.columns)), F.array(*wide.columns))).alias("measure", "n"))


def retrieval(records: DataFrame, outcomes: DataFrame, texts: DataFrame, wrong: DataFrame) -> DataFrame:
    """Every report in search order: the title of its longest abstract, its first DOI, its outcomes by scope and stage, its full text or what was wrong.

    records (report_id, input_pos, title, abstract, doi); outcomes (report_id, scope, stage, outcome); texts
    (report_id, file), without sentinels; wrong (report_id, note): shown only where there is no text.
    """
    best = F.max_by("title", F.struct(F.length(F.coalesce("abstract", F.lit(""))).alias("n"), (-F.col("input_pos")).alias("p")))
    own = records.groupBy("report_id").agg(F.min("input_pos").alias("position"), best.alias("title"), F.min_by("doi", F.when(F.col("doi").isNotNull(), F.col("input_pos"))).alias("doi"))
    said = outcomes.groupBy("report_id").agg(F.array_sort(F.collect_list(F.concat_ws("/", "scope", "stage", F.coalesce("outcome", F.lit("open"))))).alias("outcomes"))
    out = own.join(said, "report_id", "left").join(texts.groupBy("report_id").agg(F.min("file").alias("full_text")), "report_id", "left").join(wrong.groupBy("report_id").agg(F.min("note").alias("note")), "report_id", "left")
    return out.select("report_id", "position", "title", "doi", F.coalesce("outcomes", F.array().cast("array<string>")).alias("outcomes"), "full_text", F.when(F.col("full_text").isNull(), F.col("note")).alias("wrong_document"))


def decided(events: DataFrame, reveal: Column) -> DataFrame:
    """The state of each assignment from its events (assignment, seq, phase: provisional, final or undo; outcome; criterion).

    A provisional decision is final at once unless `reveal` (a condition on it) holds: then the item awaits a
    final decision. A final decision counts only while one is awaited, a provisional one only while none
    stands; others are refused. An undo takes the standing decision back.
    """
    kinds = dict(events.dtypes)
    own = events.withColumn("shown", F.coalesce(reveal, F.lit(False))).select("assignment", "seq", "phase", "outcome", "criterion", "shown")

    def fold(rows: list[tuple]) -> list[tuple]:
        state, outcome, criterion, first, refused = "pending", None, None, None, []
        for _, seq, phase, said, why, shown in rows:
            if phase == "provisional" and state == "pending":
                state, outcome, criterion, first = ("awaiting_final" if shown else "decided"), said, why, said
            elif phase == "final" and state == "awaiting_final":
                state, outcome, criterion = "decided", said, why
            elif phase == "undo" and state != "pending":
                state, outcome, criterion, first = "pending", None, None, None
            else:
                refused.append(int(seq))
        return [(rows[0][0], state, outcome, criterion, first, refused)]

    return folded(own, ["assignment"], ["seq"], fold, f"assignment {kinds['assignment']}, state string, outcome string, criterion string, provisional string, refused array<long>")


def rejudged(readings: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what holds, the log): fresh readings (item, seq, protocol_hash, proposal) replace earlier ones; all stay in the log."""
    log = readings.unionByName(fresh)
    row = F.struct(*log.columns)
    return log.groupBy("item").agg(F.max_by(row, "seq").alias("r")).select("r.*"), log
