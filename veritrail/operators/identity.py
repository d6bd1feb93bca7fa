"""Identity of reports over revisions: report views, why records are grouped, tags of entities."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.operators.folds import folded
from veritrail.operators.joins import shuffled


def report_view(records: DataFrame, links: DataFrame) -> DataFrame:
    """Reports in the order of their first record: records, searches, strongest relation."""
    own = records.join(links.select("occurrence_id", "report_id", "relation"), "occurrence_id")
    strength = F.array_position(F.array(F.lit("none"), F.lit("same_study"), F.lit("same_record")), F.col("relation"))
    return own.groupBy("report_id").agg(F.min("input_pos").alias("first"), F.array_sort(F.collect_set("occurrence_id")).alias("records"), F.array_sort(F.collect_set("search_id")).alias("searches"), F.max_by("relation", strength).alias("relation"))


def chain(revisions: DataFrame, head: str) -> DataFrame:
    """(revision_id, depth): the revisions from a head to its root, by parent; revisions are those of one project.

    Pointer doubling: each round, a revision's pointer leaps as far again, so a history of n takes log n joins.
    A cycle ends the job.
    """
    from veritrail.plans.session import written

    parent = revisions.select("revision_id", F.col("parent_id").alias("to"))
    found = parent.where(F.col("revision_id") == head).select("revision_id", F.lit(0).alias("depth"))
    leap, far = written(parent), 1
    found = written(found)
    most = leap.count()
    while True:
        further = found.join(shuffled(leap), "revision_id").where("to is not null").select(F.col("to").alias("revision_id"), (F.col("depth") + far).alias("depth"))
        further = written(further.join(shuffled(parent.select("revision_id")), "revision_id", "left_semi"))
        if not further.limit(1).count():
            return found
        if far > most:
            raise ValueError("the revisions form a cycle")
        found = written(found.union(further))
        leap = written(leap.alias("a").join(shuffled(leap.alias("b")), F.col("a.to") == F.col("b.revision_id")).select(F.col("a.revision_id").alias("revision_id"), F.col("b.to").alias("to")))
        far *= 2


def why(events: DataFrame) -> DataFrame:
    """events (project_id, seq, kind: merge or split, occurrence_ids, said): the sets of each project that still stand together, with what joined them.

    A merge makes one set of its records' sets; a split takes its records out of theirs. An
    ordered fold: each project by itself.
    """
    kinds = dict(events.dtypes)

    def fold(own: list[tuple]) -> Iterator[tuple]:
        held: dict[int, tuple[set, tuple]] = {}  # by the event that made the set: its records, and what joined them as a tree
        of: dict = {}  # the set each record is in, by a name that stays when sets merge
        names: dict[int, int] = {}  # name -> the event that made its set last
        single: set[int] = set()  # names of sets without a second record
        for at, (project, _, kind, ids, said) in enumerate(own):
            ids = set(ids)
            if kind == "merge":
                met = sorted({of[x] for x in ids if x in of}, key=names.get)
                sets = [held.pop(names[m]) for m in met]
                name = max(zip((len(s) for s, _ in sets), met), default=(0, at))[1]
                joined = next((s for m, (s, _) in zip(met, sets) if m == name), set())
                for m, (s, _) in zip(met, sets):
                    if m != name:
                        joined |= s
                        of.update(dict.fromkeys(s, name))
                        del names[m]
                        single.discard(m)
                joined |= ids
                of.update(dict.fromkeys(ids, name))
                names[name], held[at] = at, (joined, (*(w for _, w in sets), said))
                (single.add if len(joined) < 2 else single.discard)(name)
            else:
                for x in ids & of.keys():
                    name = of.pop(x)
                    rest = held[names[name]][0]
                    rest.discard(x)
                    if len(rest) < 2:
                        single.add(name)
                for name in single:
                    for x in held.pop(names.pop(name))[0]:
                        del of[x]
                single.clear()
        for records, tree in held.values():
            said, open_ = [], [tree]
            while open_:
                node = open_.pop()
                if isinstance(node, tuple):
                    open_.extend(reversed(node))
                else:
                    said.append(node)
            yield own[0][0], sorted(records), said

    own = events.select("project_id", "seq", "kind", "occurrence_ids", "said")
    return folded(own, ["project_id"], ["seq"], fold, f"project_id {kinds['project_id']}, occurrence_ids {kinds['occurrence_ids']}, why array<string>")


TAG = "doc string, start int, end int, surface string, kind string"


def place_tags(tags: DataFrame, texts: DataFrame) -> DataFrame:
    """Tags (doc, n, start, surface, kind) on texts: their own offset if the surface stands there, else the next whole-word place; each place once."""

    def fold(own: list[tuple]) -> list[tuple]:
        text = own[0][5] or ""
        used, out = set(), []
        for doc, _, start, surface, kind, _ in own:
            start = int(start)
            if text[start : start + len(surface)] != surface or start in used:
                found = (m.start() for m in re.finditer(rf"(?<!\w){re.escape(surface)}(?!\w)", text))
                start = next((s for s in found if s not in used), -1)
            if start >= 0:
                used.add(start)
                out.append((doc, start, start + len(surface), surface, kind))
        return out

    own = tags.select("doc", "n", "start", "surface", "kind").join(texts.select("doc", "text"), "doc")
    return folded(own, ["doc"], ["n"], fold, TAG)
