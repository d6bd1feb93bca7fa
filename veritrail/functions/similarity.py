"""String similarities that Spark lacks, as Arrow-batched functions of two columns.

The Indel ratio of two strings is 200 * LCS / (sum of lengths), 100 for two empty ones.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    if len(a) > len(b):
        a, b = b, a
    at = letter_places(a)
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def letter_places(a: str) -> dict[str, int]:
    """The places of each character, as bits."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    return at


def ratio_within(a: str, places: dict[str, int], b: str, least: float) -> float | None:
    """Ratio of a (and its letter_places) and b if it is at least `least`, else None.

    The rows of lcs; where the best of what b has so far and of the stretch of a that it can meet leaves out too much, it ends.
    """
    n = len(a) + len(b)
    limit = int((100 - least) * n / 100 + 1e-9)
    gone, new = (limit + len(a) - len(b)) // 2, (limit + len(b) - len(a)) // 2  # characters of a, of b, that may be left out
    if gone < 0 or new < 0:
        return None
    full = (1 << len(a)) - 1
    row = full
    for t, c in enumerate(b, 1):
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
        if not t & 31:
            reach = min(t + gone, len(a))
            if reach - (row & ((1 << reach) - 1)).bit_count() < t - new:
                return None
    found = 200.0 * (len(a) - row.bit_count()) / n if n else 100.0
    return found if found >= least else None


def packed_places(a: str) -> tuple[int, int, dict[str, bytes]]:
    """(characters, bytes, places of each character), the places with a free bit on top, to stand in a row of lcs beside others."""
    size = len(a) // 8 + 1
    return len(a), size, {c: bits.to_bytes(size, "little") for c, bits in letter_places(a).items()}


def lcs_of_many(b: str, packed: list[tuple[int, int, dict[str, bytes]]]) -> np.ndarray:
    """lcs of b and each of some strings (by packed_places): the rows of lcs of all of them as one number."""
    none = [bytes(size) for _, size, _ in packed]
    full = int.from_bytes(b"".join(((1 << n) - 1).to_bytes(size, "little") for n, size, _ in packed), "little")
    at = {c: int.from_bytes(b"".join(p.get(c, z) for (_, _, p), z in zip(packed, none)), "little") for c in set(b)}
    row = full
    for c in b:
        hit = row & at[c]
        row = ((row + hit) | (row ^ hit)) & full
    sizes = np.array([size for _, size, _ in packed])
    ones = np.bitwise_count(np.frombuffer(row.to_bytes(int(sizes.sum()), "little"), np.uint8))
    return np.array([n for n, _, _ in packed]) - np.add.reduceat(ones.astype(np.int64), np.cumsum(sizes) - sizes)


class Beside:
    """Strings to be scored side by side: their characters, and the places of a character in each as bits, found when it is asked for."""

    #: Characters whose places are kept.
    KEPT = 64

    def __init__(self, strings: list[str]):
        self.n = np.array([len(s) for s in strings], np.int64)
        width = 8 * (int(self.n.max(initial=0)) // 8 + 1)  # a free bit on top
        codes = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.codes = np.zeros((len(strings), width), np.uint32)
        self.codes[np.arange(width) < self.n[:, None]] = codes + 1
        self._held: dict[str, np.ndarray] = {}

    def bits(self, c: str, rows: np.ndarray, size: int) -> np.ndarray:
        """(rows, size) bytes: the places of c."""
        if c not in self._held and len(self._held) < self.KEPT:
            self._held[c] = np.packbits(self.codes == ord(c) + 1, axis=1, bitorder="little")
        if c in self._held:
            return self._held[c][rows, :size]
        return np.packbits(self.codes[rows, : 8 * size] == ord(c) + 1, axis=1, bitorder="little")

    def ratios_within(self, b: str, rows: np.ndarray, least: float) -> list[tuple[int, float]]:
        """(row, ratio) of those rows whose ratio with b is at least `least`; neither b nor the rows are empty.

        Rows of lcs as one number, as far as the limit lets a character stand from its place; every so often those leave that can't come to the
        least, by the test of ratio_within.
        """
        n, m = self.n[rows], len(b)
        limit = ((100 - least) * (n + m) / 100 + 1e-9).astype(np.int64)
        gone, new = (limit + n - m) // 2, (limit + m - n) // 2
        fits = (gone >= 0) & (new >= 0)
        rows, n, gone, new = rows[fits], n[fits], gone[fits], new[fits]
        whole = lambda bits: int.from_bytes(bits.tobytes(), "little")
        line, step = np.zeros((len(rows), 0), np.uint8), max(32, m // 9)
        for t in range(0, m, step):
            if not len(rows):
                return []
            done = min(t + step, m)
            reach = np.minimum(done + gone, n)
            size, held = int(reach.max()) // 8 + 1, line.shape[1]
            below = np.packbits(np.arange(8 * size, dtype=np.int32) < reach[:, None], axis=1, bitorder="little")
            if size > held:
                line = np.concatenate([line, np.full((len(rows), size - held), 255, np.uint8)], axis=1)
            line = line[:, :size]
            # where the last stretch ended inside a byte, the places behind it are free too
            if t:
                line |= below & ~np.packbits(np.arange(8 * size, dtype=np.int32) < last[:, None], axis=1, bitorder="little")
            full, row = whole(below), whole(line & below)
            at = {c: whole(self.bits(c, rows, size)) for c in set(b[t:done])}
            for c in b[t:done]:
                hit = row & at[c]
                row = ((row + hit) | (row ^ hit)) & full
            line = np.frombuffer(row.to_bytes(line.size, "little"), np.uint8).reshape(line.shape)
            found = reach - np.bitwise_count(line).sum(1, dtype=np.int64)
            fits = found >= done - new
            rows, n, gone, new, line, found, last = rows[fits], n[fits], gone[fits], new[fits], line[fits], found[fits], reach[fits]
        scores = 200.0 * found / (n + m)
        return [(i, score) for i, score in zip(rows.tolist(), scores.tolist()) if score >= least]


def ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 200.0 * lcs(a, b) / n if n else 100.0


def token_sort(a: str, b: str) -> float:
    """Ratio of the strings with their words in order."""
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """Best ratio among shared words, shared with a's rest, shared with b's rest; 100 if one's words are all shared."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    rest_a, rest_b = sorted(x - y), sorted(y - x)
    if both and (not rest_a or not rest_b):
        return 100.0
    full_a, full_b = (" ".join([both, *r] if both else r) for r in (rest_a, rest_b))
    found = ratio(full_a, full_b)
    return max(found, ratio(both, full_a), ratio(both, full_b)) if both else found


def lcs_of_stretches(short: str, long: str) -> np.ndarray:
    """lcs of `short` and each stretch of `long` that is as long: the rows of lcs, 64 bits a word, for all stretches at once."""
    n, words = len(short), -(-len(short) // 64)
    letters = {c: i for i, c in enumerate(dict.fromkeys(short), 1)}
    at = np.zeros((len(letters) + 1, words), np.uint64)
    for i, c in enumerate(short):
        at[letters[c], i // 64] |= np.uint64(1 << i % 64)
    codes = np.array([letters.get(c, 0) for c in long])
    stretches = len(long) - n + 1
    rows = [np.full(stretches, (1 << min(64, n - 64 * w)) - 1, np.uint64) for w in range(words)]
    masks = [at[codes, w] for w in range(words)]
    for k in range(n):
        carry = None
        for w, row in enumerate(rows):
            hit = row & masks[w][k : k + stretches]
            total = row + hit
            over = total < row
            if carry is not None:
                total += carry
                over |= total < carry
            carry = over.astype(np.uint64) if words > 1 else None
            rows[w] = total | (row ^ hit)
    full = [np.uint64((1 << min(64, n - 64 * w)) - 1) for w in range(words)]
    return n - sum(np.bitwise_count(row & f).astype(np.int64) for row, f in zip(rows, full))


def partial(short: str, long: str) -> tuple[float, int, int]:
    """(ratio, start, end) of the stretch of `long`, as long as `short`, that is most like it; the first of several."""
    n = len(short)
    if not n or len(long) <= n:
        return ratio(short, long), 0, len(long)
    if set(short).isdisjoint(long):
        return 0.0, 0, n
    found = lcs_of_stretches(short, long)
    start = int(found.argmax())
    return 200.0 * int(found[start]) / (2 * n), start, start + n


def osa(a: str, b: str, limit: int) -> int:
    """Edit distance with swaps of neighbours, each place edited once; limit + 1 if it is more than limit."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    old, row = [], list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            cost = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d))
            if i > 1 and j > 1 and c == b[j - 2] and a[i - 2] == d:
                cost = min(cost, old[j - 2] + 1)
            new.append(cost)
        if min(new) > limit:
            return limit + 1
        old, row = row, new
    return min(row[-1], limit + 1)


def _pairs(function, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else function(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairs(ratio, a, b)


@F.pandas_udf(T.DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairs(token_sort, a, b)


@F.pandas_udf(T.DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairs(token_set, a, b)


@F.pandas_udf(T.DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairs(lambda x, y: partial(*sorted((x, y), key=len))[0], a, b)


def osa_distance(limit: int):
    @F.pandas_udf(T.IntegerType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else osa(x, y, limit) for x, y in zip(a, b)], dtype="Int32")

    return run
