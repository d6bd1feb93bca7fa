"""Places in texts: quotes, highlights, sections, mentions. Offsets are code points, half-open."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
SPANS = T.ArrayType(SPAN)
TAGGED = T.ArrayType(T.StructType([*SPAN.fields, T.StructField("tag", T.StringType())]))
SOFT = "­"


def _pattern(quote: str) -> re.Pattern | None:
    """A quote with any white space, soft hyphens anywhere, and hyphens at line ends kept or joined."""
    words = unicodedata.normalize("NFC", quote).replace(SOFT, "").split()
    if not words:
        return None
    gap = rf"(?:{SOFT}?(?:-\s*\n\s*)?)"
    letters = lambda w: gap.join(rf"-{SOFT}?\s*" if c == "-" else re.escape(c) for c in w)
    return re.compile(rf"{SOFT}?\s+".join(map(letters, words)))


def _bare(text: str) -> str:
    """A text without what may stand between the letters of a quote."""
    return "".join(text.replace(SOFT, "").replace("-", "").split())


def _words_at(words: list[str], text: str) -> list[tuple[int, int]]:
    """All places of words with white space between them."""
    out, start = [], text.find(words[0])
    while start >= 0:
        end = start + len(words[0])
        for w in words[1:]:
            at = end
            while at < len(text) and text[at].isspace():
                at += 1
            if at == end or not text.startswith(w, at):
                break
            end = at + len(w)
        else:
            out.append((start, end))
        start = text.find(words[0], start + 1)
    return out


def find_quote(quote: str, text: str) -> list[tuple[int, int]]:
    """All places of a quote in the NFC form of a text, overlapping ones too.

    A pattern of each quote takes longer to make than to use, so one is made only for texts that hold the
    quote's letters in order, and hyphens.
    """
    own, out, at = unicodedata.normalize("NFC", text), [], 0
    plain = unicodedata.normalize("NFC", quote).replace(SOFT, "")
    if not plain.split() or _bare(plain) not in _bare(own):
        return []
    if SOFT not in own and "-" not in own:
        return _words_at(plain.split(), own)
    pattern = _pattern(quote)
    while pattern is not None and (m := pattern.search(own, at)):
        out.append(m.span())
        at = m.start() + 1
    return out


def whole_tokens(quote: str, text: str) -> list[tuple[int, int]]:
    """Those that begin and end at token borders; a digit's border is no decimal mark between digits."""
    own = unicodedata.normalize("NFC", text)

    def cut(i: int) -> bool:
        if i <= 0 or i >= len(own):
            return True
        a, b = own[i - 1], own[i]
        if a.isalnum() and b.isalnum():
            return False
        inner = (a in ".," and b.isdigit() and i >= 2 and own[i - 2].isdigit()) or (b in ".," and a.isdigit() and i + 1 < len(own) and own[i + 1].isdigit())
        return not inner

    return [s for s in find_quote(quote, text) if cut(s[0]) and cut(s[1])]


def _rows(found) -> list[dict]:
    return [{"start": a, "end": b} for a, b in found]


@F.pandas_udf(SPANS)
def quote_places(quote: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([[] if q is None or t is None else _rows(find_quote(q, t)) for q, t in zip(quote, text)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def cut_out(text: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
    """The stretches of a text between starts and ends, all in one go: Spark's substring goes through the text for each."""
    return pd.Series([None if t is None else [t[i:j] for i, j in zip(a, b)] for t, a, b in zip(text, start, end)])


@F.pandas_udf(SPANS)
def token_places(quote: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([[] if q is None or t is None else _rows(whole_tokens(q, t)) for q, t in zip(quote, text)])


def highlights(keywords: dict[str, list[str]]):
    """Keyword places, tagged: tag -> keywords; a keyword is no part of a longer word; sorted."""
    patterns = {tag: re.compile("|".join(rf"(?<!\w){re.escape(k)}(?!\w)" for k in sorted(words, key=len, reverse=True)), re.I) for tag, words in keywords.items() if words}

    @F.pandas_udf(TAGGED)
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [] if t is None else sorted(({"start": m.start(), "end": m.end(), "tag": tag} for tag, p in patterns.items() for m in p.finditer(t)), key=lambda r: (r["start"], r["end"], r["tag"])))

    return run


LABEL = re.compile(r"(?:^|(?<=[.\n] ))([A-Z][A-Z /&-]{2,40}):", re.M)


@F.pandas_udf(TAGGED)
def sections(text: pd.Series) -> pd.Series:
    """Parts of an abstract by its labels in capitals; text before the first label has an empty tag."""

    def one(t):
        if not t:
            return []
        marks = [(m.start(), m[1].strip()) for m in LABEL.finditer(t)]
        if not marks or marks[0][0] > 0:
            marks.insert(0, (0, ""))
        ends = [m[0] for m in marks[1:]] + [len(t)]
        return [{"start": s, "end": e, "tag": tag} for (s, tag), e in zip(marks, ends) if t[s:e].strip()]

    return text.map(one)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def utf16_offsets(text: pd.Series, offsets: pd.Series) -> pd.Series:
    """Code-point offsets as UTF-16 offsets."""
    return pd.Series([None if t is None or o is None else [int(i) + sum(ord(c) > 0xFFFF for c in t[:i]) for i in o] for t, o in zip(text, offsets)])
