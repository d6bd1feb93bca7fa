"""Exact and closed-form statistics. Plain functions on numbers, and Column forms of them.

Tails are sums of exact log probabilities (lgamma); inversions are bisections. Undefined
cases raise ValueError here and are null as columns.
"""

from __future__ import annotations

import math
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for n trials."""
    if k < 0:
        return 0.0
    if k >= n or p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    return min(1.0, math.fsum(math.exp(_log_choose(n, i) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1)))


def hypergeometric_cdf(k: int, population: int, marked: int, drawn: int) -> float:
    """P(X <= k) marked items among those drawn without replacement."""
    low, high = max(0, drawn - (population - marked)), min(marked, drawn)
    if k < low:
        return 0.0
    if k >= high:
        return 1.0
    whole = _log_choose(population, drawn)
    term = lambda i: math.exp(_log_choose(marked, i) + _log_choose(population - marked, drawn - i) - whole)
    if k - low <= high - k:
        return min(1.0, math.fsum(term(i) for i in range(low, k + 1)))
    return max(0.0, 1.0 - math.fsum(term(i) for i in range(k + 1, high + 1)))


def _root(f, lo: float, hi: float) -> float:
    """Where a falling function crosses zero."""
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) > 0 else (lo, mid)
    return (lo + hi) / 2


def clopper_pearson(successes: int, trials: int, confidence: float = 0.95, sided: str = "one") -> tuple[float, float]:
    """Exact bounds of a proportion; one-sided: each end at the full tail."""
    if trials < 1 or not 0 <= successes <= trials:
        raise ValueError("counts")
    tail = (1 - confidence) / (1 if sided == "one" else 2)
    lower = 0.0 if successes == 0 else _root(lambda p: tail - (1 - binomial_cdf(successes - 1, trials, p)), 0, 1)
    upper = 1.0 if successes == trials else _root(lambda p: binomial_cdf(successes, trials, p) - tail, 0, 1)
    return lower, upper


def recall_needed(target: float, confidence: float = 0.95, sided: str = "one") -> int:
    """Least number of relevant records without a miss that certifies a recall."""
    alpha = (1 - confidence) / (1 if sided == "one" else 2)
    return max(1, math.ceil(math.log(alpha) / math.log(target)))


def _first(f, lo: int, hi: int) -> int:
    """The least whole number in [lo, hi] with f true (hi if none before); f turns true once."""
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if f(mid) else (mid + 1, hi)
    return lo


def hypergeometric_bounds(population: int, sampled: int, found: int, alpha: float) -> tuple[int, int]:
    """Marked counts of the population that neither one-sided tail rejects at alpha."""
    lower = _first(lambda k: 1 - hypergeometric_cdf(found - 1, population, k, sampled) > alpha, found, population)
    if hypergeometric_cdf(found, population, population, sampled) > alpha:
        return lower, population
    return lower, _first(lambda k: hypergeometric_cdf(found, population, k, sampled) <= alpha, found, population) - 1


def elusion(strata: list[tuple[int, int, int]], confidence: float = 0.95) -> tuple[float, float, float]:
    """(estimate, lower, upper) of all relevant records from (population, sampled, found) strata, bounds simultaneous."""
    estimate = lower = upper = 0.0
    for population, sampled, found in strata:
        if population < 1:
            if sampled or found:
                raise ValueError("a sample from an empty stratum")
            continue
        if not 1 <= sampled <= population or not 0 <= found <= sampled:
            raise ValueError("sample of a stratum")
        estimate += population * found / sampled
        lo, hi = (found, found) if sampled == population else hypergeometric_bounds(population, sampled, found, (1 - confidence) / len(strata))
        lower, upper = lower + lo, upper + hi
    return estimate, lower, upper


def stop_p(labels: list[bool], remaining: int, target: float) -> float:
    """p-value of 'recall is under target' from ordered screening labels: the least over all suffixes."""
    n, seen = len(labels), sum(labels)
    total = n + remaining
    if not remaining or seen / total >= target:
        return 0.0
    best, hits = 1.0, 0
    for size in range(1, n + 1):
        hits += bool(labels[n - size])
        marked = math.floor(seen / target - (seen - hits) + 1)
        population = total - (n - size)
        if 0 <= marked <= population and size <= population:
            best = min(best, hypergeometric_cdf(hits, population, marked, size))
    return best


def stop_p_counts(screened: int, found: int, remaining: int, target: float) -> float:
    """The same from counts alone: conservative."""
    total = screened + remaining
    if not remaining or found / total >= target:
        return 0.0
    return hypergeometric_cdf(found, total, math.floor(found / target) + 1, screened)


def chapman(n1: int, n2: int, both: int, confidence: float = 0.95) -> tuple[float, float, float]:
    """(estimate, lower, upper) of a population from two sources; no upper end without an overlap."""
    tail = (1 - confidence) / 2
    least = max(n1, n2, n1 + n2 - both)
    most = max(least, math.ceil(n1 * n2 / (tail * both if both else 1 - tail)) + 2)
    lower = _first(lambda n: hypergeometric_cdf(both, n, n1, n2) > tail, least, most)
    upper = math.inf
    if both:
        upper = _first(lambda n: 1 - hypergeometric_cdf(both - 1, n, n1, n2) <= tail, least, most) - 1
        if lower > upper:
            raise ValueError("no population fits the overlap")
    return (n1 + 1) * (n2 + 1) / (both + 1) - 1, float(lower), float(upper)


def conformal_order(n: int, target: float, alpha: float) -> int:
    """The order statistic (from 1) of n calibration scores that keeps the recall; ValueError if n is too small."""
    below = bisect_right(range(n), alpha, key=lambda k: binomial_cdf(k, n, 1 - target)) - 1
    if below < 0:
        raise ValueError(f"at least {recall_needed(target, 1 - alpha)} scores are needed")
    return below + 1


# Columns


def recall_needed_column(target: Column, confidence: float = 0.95) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.log(F.lit(1 - confidence)) / F.log(target)).cast("int"))


def chapman_estimate(n1: Column, n2: Column, both: Column) -> Column:
    return (n1 + 1) * (n2 + 1) / (both + 1) - 1


def loglinear_unseen(n: dict[str, Column]) -> tuple[Column, Column]:
    """(unseen, variance of its log) from the seven cells '111' to '001' of three sources; null with a zero cell.

    The model without a three-way term has as many parameters as cells, so it solves in closed form.
    """
    cells = list(n.values())
    some = cells[0] > 0
    for c in cells[1:]:
        some = some & (c > 0)
    log = F.log(n["111"]) + F.log(n["100"]) + F.log(n["010"]) + F.log(n["001"]) - F.log(n["110"]) - F.log(n["101"]) - F.log(n["011"])
    return F.when(some, F.exp(log)), F.when(some, sum((1 / c for c in cells[1:]), 1 / cells[0]))


@F.pandas_udf(T.StructType([T.StructField("lower", T.DoubleType()), T.StructField("upper", T.DoubleType())]))
def clopper_pearson_column(successes: pd.Series, trials: pd.Series) -> pd.DataFrame:
    out = [(None, None) if pd.isna(s) or pd.isna(t) or not 0 <= s <= t or t < 1 else clopper_pearson(int(s), int(t)) for s, t in zip(successes, trials)]
    return pd.DataFrame(out, columns=["lower", "upper"], dtype="float64")


def stop_test_column(target: float):
    @F.pandas_udf(T.DoubleType())
    def run(labels: pd.Series, remaining: pd.Series) -> pd.Series:
        return pd.Series([stop_p([bool(x) for x in row], int(r), target) for row, r in zip(labels, remaining)], dtype="float64")

    return run
