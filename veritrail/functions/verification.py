"""Checks of a 'not met' answer against the text it quotes. Own, documented rules; the first that fails is named.

1. found: the quote stands in the text. 2. one_sentence: it spans no sentence end.
3. key_term: a term of the criterion, or one like it, stands in the quote.
4. negation: for an answer that rests on absence, a negation stands at most three words before the term.
5. whole_reading: 'not reported' answers need the whole text to lack the terms.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritrail.functions import spans

NEGATIONS = {"no", "not", "without", "neither", "nor", "never", "excluded", "exclude", "excluding", "lack", "lacked", "kein", "keine", "nicht", "ohne"}
SENTENCE = re.compile(r"[.!?]\s+[A-ZÄÖÜ]")
WORD = re.compile(r"[^\W_]+")


def stem(word: str) -> str:
    w = word.casefold()
    return next((w[: -len(s)] for s in ("es", "en", "s", "e", "n") if w.endswith(s) and len(w) - len(s) >= 3), w)


def failed_check(quote: str, text: str, terms: list[str], basis: str) -> str | None:
    """basis: stated, negated or absent."""
    stems = {stem(t) for t in terms for t in WORD.findall(t)}
    if basis == "absent":
        return "whole_reading" if stems & {stem(w) for w in WORD.findall(text)} else None
    if not quote.strip() or not spans.find_quote(quote, text):
        return "found"
    if SENTENCE.search(quote):
        return "one_sentence"
    words = WORD.findall(quote)
    at = [i for i, w in enumerate(words) if stem(w) in stems]
    if not at:
        return "key_term"
    if basis == "negated" and not any(words[j].casefold() in NEGATIONS for i in at for j in range(max(0, i - 3), i)):
        return "negation"
    return None


@F.pandas_udf(T.StringType())
def verification(quote: pd.Series, text: pd.Series, terms: pd.Series, basis: pd.Series) -> pd.Series:
    """Name of the failed check; null if the answer stands."""
    return pd.Series([failed_check(q or "", t or "", list(k) if k is not None else [], b or "stated") for q, t, k, b in zip(quote, text, terms, basis)])


def criterion_terms(keywords: list[str], wording: str, common: set[str], most: int = 12) -> list[str]:
    """Keywords, then words of five letters and more of the wording that aren't common."""
    rest = [w for w in WORD.findall(wording) if len(w) >= 5 and w.casefold() not in common]
    return list(dict.fromkeys([*keywords, *rest]))[:most]
