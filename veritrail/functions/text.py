"""Text, identifier and name functions as Column -> Column builders.

Only Unicode normalisation and accent folding need Python; they are Arrow-batched.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Resolver prefixes of a DOI, tried in this order.
DOI_PREFIXES = [
    "https://doi.org/",
    "http://doi.org/",
    "https://dx.doi.org/",
    "http://dx.doi.org/",
    "https://www.doi.org/",
    "http://www.doi.org/",
    "doi.org/",
    "dx.doi.org/",
    "doi:",
]


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode NFC."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(T.StringType())
def without_marks(text: pd.Series) -> pd.Series:
    """Unicode NFD without combining marks."""
    def one(t):
        if t is None or t.isascii():
            return t
        return "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.category(c).startswith("M"))

    return text.map(one)


@F.pandas_udf(T.StringType())
def fold_accents(text: pd.Series) -> pd.Series:
    """NFKD without combining marks, case-folded, white space squeezed."""

    def one(t):
        if t is None:
            return None
        plain = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
        return " ".join(plain.casefold().split())

    return text.map(one)


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def canonical_doi(value: Column) -> Column:
    """The bare lower-case DOI, without the first resolver prefix that fits; null if nothing is left."""
    doi = F.lower(F.trim(value))
    out = doi
    for prefix in reversed(DOI_PREFIXES):
        out = F.when(doi.startswith(prefix), F.trim(F.substr(doi, F.lit(len(prefix) + 1)))).otherwise(out)
    return blank_to_null(out)


def bare_doi(value: Column) -> Column:
    """The DOI without its prefix, in its own case."""
    own = F.trim(value)
    longest = "|".join(p.replace(".", r"\.") for p in DOI_PREFIXES)
    return blank_to_null(F.trim(F.regexp_replace(own, f"(?i)^(?:{longest})", "")))


def pmid(value: Column) -> Column:
    return blank_to_null(F.regexp_replace(value, r"[^0-9]", ""))


def pmcid(value: Column) -> Column:
    digits = pmid(value)
    return F.when(digits.isNotNull(), F.concat(F.lit("PMC"), digits))


def registry_id(value: Column) -> Column:
    return blank_to_null(F.upper(F.trim(value)))


def registry_ids(*texts: Column) -> Column:
    """Trial numbers in the texts: NCT numbers first, then EudraCT and EU CT numbers (with their last group), each once."""
    joined = F.concat_ws("\n", *texts)
    nct = F.transform(F.regexp_extract_all(joined, F.lit(r"(?i)\bNCT[0-9]{8}\b"), F.lit(0)), F.upper)
    eudract = F.regexp_extract_all(joined, F.lit(r"\b[0-9]{4}-[0-9]{6}-[0-9]{2}(?:-[0-9]{2})?\b"), F.lit(0))
    return F.array_distinct(F.concat(nct, eudract))


def year_in(text: Column, first: int = 18) -> Column:
    """The first year of the centuries from `first` to 20, as a word of its own."""
    centuries = "|".join(str(c) for c in range(first, 21))
    return blank_to_null(F.regexp_extract(text, rf"\b((?:{centuries})[0-9]{{2}})\b", 1)).cast("int")


def plain_title(title: Column, composed: bool = True) -> Column:
    """Lower case, everything but letters, digits and underscore as a space, squeezed.

    composed: the title is NFC already, as all texts of one corpus usually are.
    """
    own = title if composed else nfc(title)
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(own), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def first_family(authors: Column) -> Column:
    """Family name of the first author as printed: before a comma; else before trailing, or after leading, initials."""
    first = F.trim(F.get(authors, F.lit(0)))
    parts = F.split(first, r"(?U)\s+")
    last = F.element_at(parts, -1)
    name = (
        F.when(F.contains(first, F.lit(",")), F.trim(F.split_part(first, F.lit(","), F.lit(1))))
        .when((F.size(parts) > 1) & (F.length(last) <= 2), F.get(parts, F.lit(0)))
        .when((F.size(parts) > 1) & (F.length(F.get(parts, F.lit(0))) <= 2), last)
        .otherwise(F.get(parts, F.lit(0)))
    )
    return blank_to_null(F.regexp_replace(name, r"(?U)[^\w]", ""))


def split_authors(cell: Column) -> Column:
    """Authors of one cell: at semicolons or line ends; at commas if each part is a family and initials; else one."""
    at_commas = F.transform(F.split(cell, ","), lambda p: F.trim(p))
    initials = F.contains(cell, F.lit(",")) & F.forall(at_commas, lambda p: p.rlike(r"^[^,]+ [A-Z][A-Z.\-]*$"))
    parts = F.when(cell.rlike(r"[;\n]"), F.split(cell, r"[;\n]")).when(initials, at_commas).otherwise(F.array(cell))
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda a: a != "")


def row_key(raw: Column) -> Column:
    """A label as a key: other characters than letters, digits, '_', '.', '-' become one '_'; 96 characters at most."""
    key = F.trim(F.regexp_replace(raw, r"[^A-Za-z0-9_.-]+", "_"))
    key = F.substring(F.regexp_replace(key, r"^_+|_+$", ""), 1, 96)
    return F.coalesce(blank_to_null(key), F.lit("row"))


def stem(word: Column) -> Column:
    """The word without its last 'es', 'en', 's', 'e' or 'n', if three characters stay."""
    out = word
    for suffix in reversed(["es", "en", "s", "e", "n"]):
        n = len(suffix)
        out = F.when(word.endswith(suffix) & (F.length(word) - n >= 3), F.substr(word, F.lit(1), F.length(word) - n)).otherwise(out)
    return out


def strip_markup(text: Column) -> Column:
    """Text without tags, entities of the five XML names resolved, squeezed; null if nothing is left."""
    out = F.regexp_replace(text, r"<[^>]*>", " ")
    for name, char in {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}.items():
        out = F.replace(out, F.lit(name), F.lit(char))
    return blank_to_null(squeeze(out))


def from_inverted_index(index: Column) -> Column:
    """The text of a map word -> positions."""
    words = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return blank_to_null(F.array_join(F.transform(F.array_sort(words), lambda s: s["w"]), " "))


# Comparison normalisers, applied in the order they are named.


def _numeric_punctuation(text: Column) -> Column:
    compact = F.regexp_replace(text, "[  ]", "")
    comma, dot = F.length(compact) - F.instr(F.reverse(compact), ","), F.length(compact) - F.instr(F.reverse(compact), ".")
    has_comma, has_dot = F.contains(compact, F.lit(",")), F.contains(compact, F.lit("."))
    many = lambda c: F.size(F.split(compact, c)) > 2
    no_comma, no_dot = F.replace(compact, F.lit(","), F.lit("")), F.replace(compact, F.lit("."), F.lit(""))
    return (
        F.when(has_comma & has_dot & (comma > dot), F.replace(no_dot, F.lit(","), F.lit(".")))
        .when(has_comma & has_dot, no_comma)
        .when(has_comma & many(","), no_comma)
        .when(has_comma, F.replace(compact, F.lit(","), F.lit(".")))
        .when(has_dot & many(r"\."), no_dot)
        .otherwise(compact)
    )


NORMALIZERS = {
    "trim": F.trim,
    "whitespace_collapse": squeeze,
    "casefold": lambda c: F.replace(F.lower(c), F.lit("ß"), F.lit("ss")),
    "numeric_punctuation": _numeric_punctuation,
    "currency_symbol": lambda c: F.trim(F.regexp_replace(F.trim(c), "^[$€£¥]+", "")),
    "percent_symbol": lambda c: F.trim(F.replace(c, F.lit("%"), F.lit(""))),
}


def normalize(value: Column, names: list[str]) -> Column:
    """A value as text under the named normalisers; null is empty."""
    out = F.coalesce(value.cast("string"), F.lit(""))
    for name in names:
        out = NORMALIZERS[name](out)
    return out


def words_folded(text: Column) -> Column:
    """Distinct lower-case words, plural 's' dropped from words of four letters and more without digits."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)[\p{L}\p{N}]+"), F.lit(0))
    plural = lambda w: w.endswith("s") & ~w.endswith("ss") & (F.length(w) > 3) & ~w.rlike("[0-9]")
    return F.array_distinct(F.transform(found, lambda w: F.when(plural(w), F.substr(w, F.lit(1), F.length(w) - 1)).otherwise(w)))


def next_label(label: Column) -> Column:
    """A dotted version label with its last number raised by one."""
    parts = F.transform(F.regexp_extract_all(label, F.lit("[0-9]+"), F.lit(0)), lambda p: p.cast("int"))
    n = F.size(parts)
    return F.array_join(F.transform(parts, lambda p, i: (p + F.when(i == n - 1, 1).otherwise(0)).cast("string")), ".")


def label_after(label: Column, before: Column) -> Column:
    """Whether a dotted label comes after another, number by number."""
    numbers = lambda c: F.transform(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)), lambda p: p.cast("int"))
    return numbers(label) > numbers(before)


def message_of(body: Column, longest: int = 200) -> Column:
    """An error message in a response body: known JSON keys in order, or short plain text, never markup."""
    paths = ["$.error.message", "$.message", "$.detail", "$.error_description", "$.error"]
    found = F.coalesce(*[F.get_json_object(body, p) for p in paths], F.when(~body.rlike(r"^\s*[<{\[]") & (F.length(body) <= longest), body))
    return blank_to_null(F.substring(squeeze(F.regexp_replace(found, r"[\x00-\x1F\x7F]", " ")), 1, longest))


def answer_json(text: Column) -> Column:
    """The JSON object of a model's answer: without thinking blocks and fences; null if other text follows it."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"```(?:json)?", "")
    return blank_to_null(F.regexp_extract(F.trim(bare), r"(?s)^[^{]*(\{.*\})$", 1))
