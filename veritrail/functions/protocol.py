"""Review protocols: reading, cross-checks, exploded criteria, differences; sentinel lists."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession

from veritrail.functions import queries
from veritrail.functions.canonical import canonical, leaves

STAGES = ["title", "full_text"]


def unique_keys(text: str) -> dict:
    """JSON in which no object names a key twice."""

    def pairs(items):
        keys = [k for k, _ in items]
        if len(keys) != len(set(keys)):
            raise ValueError(f"a key stands twice: {sorted(k for k in keys if keys.count(k) > 1)[0]!r}")
        return dict(items)

    return json.loads(text, object_pairs_hook=pairs)


def problems(protocol: dict) -> list[tuple[str, str]]:
    """(path, problem) of a protocol: repeated ids, unknown references, missing or contradicting requirements, bad strategies."""
    out = []
    ids: dict[str, str] = {}
    for kind in ("questions", "topics", "criteria", "sources", "outcomes"):
        for i, item in enumerate(protocol.get(kind, [])):
            path = f"/{kind}/{i}"
            if not item.get("id"):
                out.append((path, "no id"))
            elif item["id"] in ids:
                out.append((path, f"the id stands at {ids[item['id']]} too"))
            else:
                ids[item["id"]] = path
    topics = {t.get("id") for t in protocol.get("topics", [])}
    for i, c in enumerate(protocol.get("criteria", [])):
        if c.get("topic") is not None and c["topic"] not in topics:
            out.append((f"/criteria/{i}/topic", "unknown topic"))
        if not set(c.get("stages", STAGES)) <= set(STAGES):
            out.append((f"/criteria/{i}/stages", "unknown stage"))
        if not c.get("text"):
            out.append((f"/criteria/{i}", "no text"))
    for i, s in enumerate(protocol.get("sources", [])):
        out += [(f"/sources/{i}/strategy", p) for p in queries.problems(s.get("strategy", ""))]
    audit, mode = protocol.get("audit", {}), protocol.get("mode")
    if mode == "single_with_ai" and not audit.get("percent"):
        out.append(("/audit", "a mode with one reader needs an audit sample"))
    recall = protocol.get("stopping", {}).get("target_recall")
    if recall is not None and not 0 < float(recall) < 1:
        out.append(("/stopping/target_recall", "between 0 and 1"))
    if len(protocol.get("sources", [])) < int(protocol.get("minimum_sources", 0)):
        out.append(("/sources", "fewer sources than required"))
    return out


def content_hash(protocol: dict) -> str:
    return hashlib.sha256(b"protocol\0" + canonical(protocol).encode()).hexdigest()


def criteria(spark: SparkSession, protocol: dict) -> DataFrame:
    """(criterion, position, topic, stage, text, short_label): a row for each stage a criterion holds in."""
    rows = [(c["id"], i, c.get("topic"), s, c.get("text"), c.get("short_label")) for i, c in enumerate(protocol.get("criteria", [])) for s in c.get("stages", STAGES)]
    return spark.createDataFrame(rows, "criterion string, position int, topic string, stage string, text string, short_label string")


def flat(spark: SparkSession, protocol: dict) -> DataFrame:
    """(path, value), list items by their id, for compare.diff_paths."""

    def keyed(value):
        if isinstance(value, dict):
            return {k: keyed(v) for k, v in value.items()}
        if isinstance(value, list) and value and all(isinstance(v, dict) and "id" in v for v in value):
            return {v["id"]: keyed(v) for v in value}
        return value

    return spark.createDataFrame(leaves(keyed(protocol)), "path string, value string")


def sentinels(spark: SparkSession, text: str) -> DataFrame:
    """(ref, outcome, problem) of a JSON list of known records."""
    rows = []
    for e in json.loads(text):
        ref = e.get("doi") or e.get("pmid") or e.get("registry_id") if isinstance(e, dict) else None
        outcome = e.get("outcome", "include") if isinstance(e, dict) else None
        problem = "no identifier" if not ref else None if outcome in ("include", "exclude") else "unknown outcome"
        rows.append((ref, outcome, problem))
    return spark.createDataFrame(rows, "ref string, outcome string, problem string")
