"""Risk-of-bias appraisal: which questions apply, judgements of the five domains, the overall one.

Answers are a map question -> answer: Y, PY, PN, N or NI. Questions are small per study, so
everything is one expression per row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Question:
    """Applies always, or if any (or all) of earlier questions were answered with one of the answers."""

    id: str
    after: tuple[str, ...] = ()
    answers: tuple[str, ...] = ()
    every: bool = False


def yes(answers: Column, question: str) -> Column:
    return F.coalesce(answers[question].isin("Y", "PY"), F.lit(False))


def no(answers: Column, question: str) -> Column:
    return F.coalesce(answers[question].isin("N", "PN"), F.lit(False))


def applies(questions: list[Question], answers: Column) -> dict[str, Column]:
    """yes, no or pending for each question; pending while an earlier answer is awaited."""
    out: dict[str, Column] = {}
    for q in questions:
        if not q.after:
            out[q.id] = F.lit("yes")
            continue
        met, wait = [], []
        for ref in q.after:
            given = answers[ref].isNotNull()
            met.append(F.coalesce((out[ref] == "yes") & answers[ref].isin(*q.answers), F.lit(False)))
            wait.append((out[ref] == "pending") | ((out[ref] == "yes") & ~given))
        some = lambda cs: cs[0] if len(cs) == 1 else cs[0] | some(cs[1:])
        if q.every:
            unmet = some([~m & ~w for m, w in zip(met, wait)])
            out[q.id] = F.when(unmet, "no").when(some(wait), "pending").otherwise("yes")
        else:
            out[q.id] = F.when(some(met), "yes").when(some(wait), "pending").otherwise("no")
    return out


LEVELS = ["low", "some_concerns", "high"]


def worst(*judgements: Column) -> Column:
    rank = F.greatest(*[F.array_position(F.array(*map(F.lit, LEVELS)), j) for j in judgements])
    return F.element_at(F.array(*map(F.lit, LEVELS)), rank.cast("int"))


def randomization(a: Column) -> Column:
    later = F.when(yes(a, "1.3"), "some_concerns")
    return (
        F.when(no(a, "1.2"), "high")
        .when(a["1.2"] == "NI", F.when(yes(a, "1.3"), "high").otherwise("some_concerns"))
        .when(no(a, "1.1"), "some_concerns")
        .otherwise(F.coalesce(later, F.lit("low")))
    )


def deviations(a: Column) -> Column:
    unaware = no(a, "2.1") & no(a, "2.2")
    first = (
        F.when(unaware | no(a, "2.3"), "low")
        .when((a["2.3"] == "NI") | no(a, "2.4"), "some_concerns")
        .when(yes(a, "2.5"), "some_concerns")
        .otherwise("high")
    )
    second = F.when(yes(a, "2.6"), "low").when(no(a, "2.7"), "some_concerns").otherwise("high")
    return worst(first, second)


def missing_data(a: Column) -> Column:
    return F.when(yes(a, "3.1") | yes(a, "3.2") | no(a, "3.3"), "low").when(no(a, "3.4"), "some_concerns").otherwise("high")


def measurement(a: Column) -> Column:
    calm = F.when(no(a, "4.2"), "low").otherwise("some_concerns")
    return F.when(yes(a, "4.1") | yes(a, "4.2"), "high").when(no(a, "4.3") | no(a, "4.4"), calm).when(no(a, "4.5"), "some_concerns").otherwise("high")


def selection(a: Column) -> Column:
    clear = no(a, "5.2") & no(a, "5.3")
    return F.when(yes(a, "5.2") | yes(a, "5.3"), "high").when(clear & yes(a, "5.1"), "low").otherwise("some_concerns")


DOMAINS = {"D1": randomization, "D2": deviations, "D3": missing_data, "D4": measurement, "D5": selection}


def judge(df, answers: str):
    """df with a judgement for each domain, and the overall one."""
    own = df.withColumns({d: f(F.col(answers)) for d, f in DOMAINS.items()})
    return own.withColumn("overall", worst(*[F.col(d) for d in DOMAINS]))
