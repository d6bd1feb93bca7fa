"""Canonical JSON (RFC 8785), content hashes and JSON pointers."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _number(x: float | int) -> str:
    """A number as ECMAScript prints it."""
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, int) and abs(x) < 2**53:
        return str(x)
    x = float(x)
    if not math.isfinite(x):
        raise ValueError("JSON has no such number")
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    digits, _, power = f"{x!r}".partition("e")
    if power:
        power = int(power)
        if -7 < power < 0:
            sign, own = ("-", digits[1:]) if digits[0] == "-" else ("", digits)
            return f"{sign}0.{'0' * (-power - 1)}{own.replace('.', '')}"
        return f"{digits.removesuffix('.0')}e{'+' if power > 0 else '-'}{abs(power)}"
    return digits


def canonical(value) -> str:
    """RFC 8785: keys by UTF-16 code units, no spaces, shortest numbers."""
    if value is None:
        return "null"
    if isinstance(value, (bool, int, float)):
        return _number(value)
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in keys) + "}"
    return "[" + ",".join(map(canonical, value)) + "]"


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """JSON text in canonical form; null where it can't be read."""

    def one(t):
        try:
            return None if t is None else canonical(json.loads(t))
        except ValueError:
            return None

    return text.map(one)


def content_hash(canonical_text: Column, domain: str) -> Column:
    """SHA-256 of domain, a zero byte and canonical JSON."""
    return F.sha2(F.concat(F.lit(domain).cast("binary"), F.lit(b"\x00"), canonical_text.cast("binary")), 256)


def field_id(specification: Column, section: Column, key: Column, row: Column | None = None) -> Column:
    return F.sha2(F.concat_ws(":", specification, section, key, *([row] if row is not None else [])), 256)


def escaped(key: Column) -> Column:
    """A key inside a JSON pointer."""
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def pointer(parent: Column, key: Column) -> Column:
    return F.concat(parent, F.lit("/"), escaped(key))


def leaves(value, path: str = "") -> list[tuple[str, str]]:
    """(pointer, canonical value) of every leaf; an empty list or object is a leaf."""
    if isinstance(value, dict) and value:
        return [x for k, v in value.items() for x in leaves(v, f"{path}/{k.replace('~', '~0').replace('/', '~1')}")]
    if isinstance(value, list) and value:
        return [x for i, v in enumerate(value) for x in leaves(v, f"{path}/{i}")]
    return [(path, canonical(value))]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType())])))
def json_leaves(text: pd.Series) -> pd.Series:
    """All leaves of JSON texts, for joins of (pointer, value) rows; a missing pointer has no row, a null is 'null'; null where the text can't be read."""

    def one(t):
        try:
            return [] if t is None else [{"path": p, "value": v} for p, v in leaves(json.loads(t))]
        except ValueError:
            return None

    return text.map(one)
