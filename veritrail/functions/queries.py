"""Boolean search strategies: syntax checks, and compilation to a Column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r'"([^"]*)"|([()])|(\S+?)(?=[()\s]|$)')
TAG = re.compile(r"\[([^\]\[]*)\]")
# Field tags a strategy may use.
TAGS = ["tiab", "ti", "ab", "mh", "mesh", "pt", "au", "tw", "dp", "la", "all"]


def problems(strategy: str) -> list[str]:
    """Unbalanced quotes, parentheses (outside quotes) and brackets, and unknown field tags."""
    out = []
    if strategy.count('"') % 2:
        out.append("a quote is left open")
    bare = re.sub(r'"[^"]*"', " ", strategy)
    depth = low = 0
    for c in bare:
        depth += (c == "(") - (c == ")")
        low = min(low, depth)
    if depth or low < 0:
        out.append("parentheses don't pair")
    open_ = False
    for c in bare:
        if c == "[" and open_ or c == "]" and not open_:
            out.append("brackets don't pair")
            break
        if c in "()" and open_:
            out.append("a parenthesis inside brackets")
            break
        open_ = c == "[" or (open_ and c != "]")
    else:
        if open_:
            out.append("brackets don't pair")
    unknown = sorted({t.lower() for t in TAG.findall(bare)} - set(TAGS))
    return out + [f"unknown field tag {t!r}" for t in unknown]


def compile_query(strategy: str, text: Column) -> Column:
    """AND, OR, NOT, quotes, a trailing * and parentheses over the words of a text; neighbours without an operator are AND."""
    if found := problems(strategy):
        raise ValueError("; ".join(found))
    plain = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"(?U)[^\w]+", " "), F.lit(" "))
    tokens = [("word", m[1]) if m[1] is not None else ("mark", m[2]) if m[2] else ("bare", m[3]) for m in TOKEN.finditer(TAG.sub("", strategy))]
    at = 0

    def term(kind: str, value: str) -> Column:
        stem = kind == "bare" and value.endswith("*")
        own = re.sub(r"[^\w]+", " ", value.lower()).strip()
        return F.contains(plain, F.lit(f" {own}" + ("" if stem else " ")))

    def factor() -> Column:
        nonlocal at
        kind, value = tokens[at]
        at += 1
        if kind == "bare" and value.upper() == "NOT":
            return ~factor()
        if (kind, value) == ("mark", "("):
            inner = either()
            at += 1
            return inner
        return term(kind, value)

    def both() -> Column:
        nonlocal at
        out = factor()
        while at < len(tokens) and tokens[at] != ("mark", ")") and not (tokens[at][0] == "bare" and tokens[at][1].upper() == "OR"):
            if tokens[at][0] == "bare" and tokens[at][1].upper() == "AND":
                at += 1
            out = out & factor()
        return out

    def either() -> Column:
        nonlocal at
        out = both()
        while at < len(tokens) and tokens[at][0] == "bare" and tokens[at][1].upper() == "OR":
            at += 1
            out = out | both()
        return out

    return either()


#: Phrases by which a text speaks to a model instead of a reader.
INJECTION = r"(?i)(ignore|disregard|forget)\s+(all\s+|any\s+)?(the\s+)?(previous|prior|above|earlier)\s+(instructions?|prompts?|rules)|you\s+are\s+(now\s+)?an?\s+(ai|assistant|language\s+model)|system\s+prompt|<\s*/?\s*(system|assistant)\s*>|(answer|respond|reply)\s+(only\s+)?with\s+[\"'‘“]?(include|exclude|met|not met)|mark\s+this\s+(study|record|paper)\s+as\s+(included?|relevant)"


def injection_suspected(text: Column) -> Column:
    return F.coalesce(text.rlike(INJECTION), F.lit(False))
