"""Comparison specifications: a small JSON document, checked and bound to a reference, as plan rows."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession

from veritrail.functions.canonical import canonical

OPERATORS = ["exact", "boolean", "date", "numeric"]
PLAN = "field string, section string, key string, pointer string, expected string, operator string, absolute double, relative double, severity string"
PROBLEM = "path string, problem string"


def at(tree, pointer: str) -> tuple[bool, object]:
    """(present, value) of a JSON pointer."""
    for part in pointer.split("/")[1:]:
        part = part.replace("~1", "/").replace("~0", "~")
        if isinstance(tree, dict) and part in tree:
            tree = tree[part]
        elif isinstance(tree, list) and part.isdigit() and int(part) < len(tree):
            tree = tree[int(part)]
        else:
            return False, None
    return True, tree


def compile_plan(spark: SparkSession, specification: str, reference: str) -> tuple[DataFrame, DataFrame]:
    """(plan, problems) of a specification {sections: [{key, fields: [{key, pointer, operator, required, tolerance}]}]}.

    A plan row is what compare.compare_fields takes; its field id follows from the canonical specification. A
    specification with a problem has no plan. Both documents are small by their nature.
    """
    rows, bad = [], []
    try:
        spec, tree = json.loads(specification), json.loads(reference)
    except ValueError as error:
        spec, tree, bad = {}, None, [("/", f"no valid JSON: {error}")]
    own = hashlib.sha256(canonical(spec).encode()).hexdigest()
    sections = spec.get("sections") if isinstance(spec, dict) else None
    if not bad and not isinstance(sections, list):
        bad.append(("/sections", "a list is expected"))
    seen: set[tuple] = set()
    for i, section in enumerate(sections if isinstance(sections, list) else []):
        for j, f in enumerate(section.get("fields", [])):
            path = f"/sections/{i}/fields/{j}"
            name = (section.get("key"), f.get("key"))
            if not all(name):
                bad.append((path, "no key"))
            elif name in seen:
                bad.append((path, "the key stands twice"))
            seen.add(name)
            if f.get("operator", "exact") not in OPERATORS:
                bad.append((path + "/operator", "unknown operator"))
            found, value = at(tree, f.get("pointer", "")) if str(f.get("pointer", "")).startswith("/") else (False, None)
            if not found and f.get("required", True):
                bad.append((path + "/pointer", "the reference has no such value"))
            if found:
                tolerance = f.get("tolerance", {})
                number = lambda k: float(tolerance[k]) if k in tolerance else None  # noqa: B023, E731
                text = value if isinstance(value, str) else None if value is None else canonical(value)
                rows.append((hashlib.sha256(f"{own}:{name[0]}:{name[1]}".encode()).hexdigest(), *name, f["pointer"], text, f.get("operator", "exact"), number("absolute"), number("relative"), f.get("severity", "major")))
    return spark.createDataFrame([] if bad else rows, PLAN), spark.createDataFrame(bad, PROBLEM)
