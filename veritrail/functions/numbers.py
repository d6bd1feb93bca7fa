"""Numbers and dates as they are printed, as Column -> Column builders on exact decimals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

DECIMAL = "decimal(38,18)"
# What a table prints for a number that was not reported.
NOT_REPORTED = ["-", "–", "—", "NA", "N/A", "NR", "NE", "not reported"]
MINUS = "−–‐‑"
#: The largest integer that every JSON reader holds exactly.
JSON_INTEGER = 9_007_199_254_740_991


@dataclass(frozen=True)
class Scalar:
    """How a value is printed. kind: text, boolean, date, percentage, decimal or integer."""

    kind: str
    decimal_mark: str = "."
    group_mark: str | None = None
    prefix: str = ""
    suffix: str = ""
    not_reported: tuple[str, ...] | None = None

    @property
    def numeric(self) -> bool:
        return self.kind in ("percentage", "decimal", "integer")


def _fold(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def parse_value(raw: Column, rule: Scalar) -> Column:
    """struct(value, status, message): status is extracted, missing or invalid; numbers stay as printed, without marks."""
    text = F.trim(raw)
    marks = rule.not_reported if rule.not_reported is not None else tuple(NOT_REPORTED) if rule.numeric else ()
    missing = text.isNull() | (text == "") | (_fold(text).isin([" ".join(m.lower().split()) for m in marks]) if marks else F.lit(False))
    own, problem = text, F.lit(None).cast("string")
    if rule.numeric:
        own = F.translate(own, MINUS, "-" * len(MINUS))
    for affix, cut in ((rule.prefix, True), (rule.suffix, False)):
        if affix:
            there = own.startswith(affix) if cut else own.endswith(affix)
            problem = F.coalesce(problem, F.when(~there, F.lit(f"{'prefix' if cut else 'suffix'} {affix!r} expected")))
            own = F.when(there, F.trim(F.substr(own, F.lit(len(affix) + 1)) if cut else F.substr(own, F.lit(1), F.length(own) - len(affix)))).otherwise(own)
    if rule.kind == "boolean":
        word = F.lower(own)
        value = F.when(word.isin("true", "yes", "1"), "true").when(word.isin("false", "no", "0"), "false")
        problem = F.coalesce(problem, F.when(value.isNull(), F.lit("true/false, yes/no or 1/0 expected")))
    elif rule.kind == "date":
        value = F.when(own.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(own, F.lit("yyyy-MM-dd")).cast("date").cast("string"))
        problem = F.coalesce(problem, F.when(value.isNull(), F.lit("ISO date expected")))
    elif rule.numeric:
        if rule.kind == "percentage":
            own = F.trim(F.regexp_replace(own, "%$", ""))
        mark = "\\" + rule.decimal_mark
        digits = r"\d+" if rule.group_mark is None else rf"(?:\d+|\d{{1,3}}(?:\{rule.group_mark}\d{{3}})+)"
        fits = own.rlike(rf"^[+-]?{digits}(?:{mark}\d+)?$")
        plain = F.replace(own, F.lit(rule.group_mark), F.lit("")) if rule.group_mark else own
        plain = F.regexp_replace(F.replace(plain, F.lit(rule.decimal_mark), F.lit(".")), r"^\+", "")
        problem = F.coalesce(problem, F.when(~fits, F.lit("digits do not follow the declared separators")))
        if rule.kind == "integer":
            whole = F.regexp_replace(plain, r"\.0+$", "")
            number = whole.try_cast("decimal(38,0)") if hasattr(whole, "try_cast") else whole.cast("decimal(38,0)")
            problem = F.coalesce(problem, F.when(F.contains(whole, F.lit(".")), F.lit("whole number expected")), F.when(number.isNull() | (F.abs(number) > F.lit(JSON_INTEGER)), F.lit("beyond the exact JSON range")))
            value = number.cast("string")
        else:
            value = F.regexp_replace(plain, r"^(-?)0+(?=\d)", "$1")
    else:
        value = own
    status = F.when(missing, "missing").when(problem.isNotNull(), "invalid").otherwise("extracted")
    return F.struct(F.when(status == "extracted", value).alias("value"), status.alias("status"), F.when(status == "invalid", problem).alias("message"))


def numbers_in(text: Column) -> Column:
    """Number tokens of a text, minus signs and spaces made plain."""
    plain = F.translate(text, MINUS + "   ", "-" * len(MINUS) + "   ")
    return F.regexp_extract_all(plain, F.lit(r"(?<![\w.])-?\d+(?:[.,]\d+)*"), F.lit(0))


def as_decimal(text: Column) -> Column:
    return text.try_cast(DECIMAL)


def well_formed(value: Column, kind: str) -> Column:
    """Null, or what is wrong with a value of the kind count, percentage, ratio, p_value or text."""
    number = as_decimal(F.regexp_replace(value, r"^[<>=≤≥]\s*", "") if kind == "p_value" else value)
    if kind == "count":
        return F.when(~value.rlike(r"^\d+$"), F.lit("whole number expected"))
    if kind == "percentage":
        return F.when(number.isNull() | (number < 0) | (number > 100), F.lit("0 to 100 expected"))
    if kind == "ratio":
        return F.when(number.isNull() | (number <= 0), F.lit("positive number expected"))
    if kind == "p_value":
        return F.when(number.isNull() | (number < 0) | (number > 1), F.lit("0 to 1 expected"))
    return F.when(F.trim(value) == "", F.lit("text expected"))


def same_value(a: Column, b: Column) -> Column:
    """Equal as numbers if both are, else as folded texts; null equals null only."""
    x, y = as_decimal(a), as_decimal(b)
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).when(x.isNotNull() & y.isNotNull(), x == y).otherwise(_fold(a) == _fold(b))


def printed_in(value: Column, quote: Column) -> Column:
    """Whether the value stands in the quote as a number of its own."""
    want = as_decimal(F.regexp_replace(value, r"^[<>=≤≥]\s*", ""))
    return F.exists(numbers_in(quote), lambda n: as_decimal(F.replace(n, F.lit(","), F.lit("."))) == want)


def as_date(text: Column) -> Column:
    """ISO, else day-first with dots."""
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
    dotted = F.when(text.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), F.try_to_timestamp(text, F.lit("d.M.yyyy")))
    return F.coalesce(iso, dotted).cast("date")


def retry_seconds(value: Column, now: Column) -> Column:
    """Seconds to wait by a Retry-After header: a number, or an HTTP date against now; never negative; null if neither."""
    text = F.trim(value)
    number = text.try_cast("double")
    date = F.try_to_timestamp(F.regexp_extract(text, r"^[A-Za-z]{3}, (\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.greatest(F.lit(0.0), F.coalesce(number, (F.unix_timestamp(date) - F.unix_timestamp(now)).cast("double"))) + F.when(number.isNull() & date.isNull(), F.lit(None).cast("double")).otherwise(0.0)


def reset_seconds(value: Column, now: Column) -> Column:
    """Seconds to wait by a rate-limit reset: an epoch second (beyond a thousand million), a delay, or an HTTP date."""
    number = F.trim(value).try_cast("double")
    return F.when(number > 1_000_000_000, F.greatest(F.lit(0.0), number - F.unix_timestamp(now))).otherwise(retry_seconds(value, now))


def as_boolean(text: Column) -> Column:
    word = F.lower(F.trim(text))
    return F.when(word.isin("true", "yes", "1"), True).when(word.isin("false", "no", "0"), False)


def agrees(expected: Column, actual: Column, operator: Column, absolute: Column, relative: Column) -> Column:
    """The comparison operators exact, boolean, date and numeric on normalised texts; what can't be read never agrees.

    Numeric: equal, or within the absolute tolerance, or within the relative one (expected 0 allows only 0).
    """
    x, y = as_decimal(expected), as_decimal(actual)
    gap = F.abs(x - y)
    near = (gap == 0) | (absolute.isNotNull() & (gap <= absolute.cast(DECIMAL))) | (relative.isNotNull() & (x != 0) & (gap <= F.abs(x) * relative.cast(DECIMAL)))
    return F.coalesce(
        F.when(operator == "exact", expected == actual)
        .when(operator == "boolean", as_boolean(expected) == as_boolean(actual))
        .when(operator == "date", as_date(expected) == as_date(actual))
        .when(operator == "numeric", near),
        F.lit(False),
    )


# Compound cells: shape -> component -> (pattern, group).
SHAPES = {
    "count_percent": r"^(\d[\d ,]*?)\s*\(\s*(\d+(?:[.,]\d+)?)\s*%?\s*\)$",
    "mean_sd": r"^(-?\d+(?:[.,]\d+)?)\s*(?:\(|±)\s*(\d+(?:[.,]\d+)?)\s*\)?$",
    "range": r"^(-?\d+(?:[.,]\d+)?)\s*(?:-|–|to)\s*(-?\d+(?:[.,]\d+)?)$",
    "estimate_interval": r"^(-?\d+(?:[.,]\d+)?)\s*[\[(]\s*(-?\d+(?:[.,]\d+)?)\s*(?:,|;|-|–|to)\s*(-?\d+(?:[.,]\d+)?)\s*[\])]$",
}
COMPONENTS = {
    "count_percent": ["count", "percent"],
    "mean_sd": ["mean", "sd"],
    "range": ["low", "high"],
    "estimate_interval": ["estimate", "lower", "upper"],
}


def component(cell: Column, shape: str, name: str) -> Column:
    """One component of a compound cell; null if the cell has another shape."""
    return F.when(cell.rlike(SHAPES[shape]), F.regexp_extract(cell, SHAPES[shape], COMPONENTS[shape].index(name) + 1))
