"""Periodic runs against a brute-force version, planted documents and odd tables."""

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from veritrail.llm import periodic_runs as P

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least, repeats):
    """All (start, length, period): every period of every stretch, kept with its least period."""
    best = {}
    for p in range(1, len(words) // repeats + 1):
        i = 0
        while i + p < len(words):
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, repeats * p):
                best.setdefault((i, j + p), p)
            i = j
    return sorted((a, b - a, p) for (a, b), p in best.items())


def stretched(rng, letters):
    """Words with stretches that repeat with some period, some nested, some cut short."""
    words = []
    for _ in range(rng.randrange(1, 6)):
        own = [rng.choice(letters) for _ in range(rng.randrange(1, 15))]
        if rng.random() < 0.3:
            own = own[:3] * rng.randrange(1, 5) + own
        words += (own * rng.randrange(1, 12))[: rng.randrange(1, 130)]
    return words


def test_runs_of_many_texts():
    rng = random.Random(4)
    for round_ in range(30):
        texts = [stretched(rng, ["a", "b", "é", "dd"][: rng.randrange(1, 5)] + [str(k) for k in range(rng.randrange(0, 30))]) for _ in range(rng.randrange(1, 9))] + [[]]
        least, repeats = rng.choice([(24, 3), (1, 2), (6, 2), (40, 4), (2, 3)])
        data = [" ".join(t).encode() for t in texts]
        off = np.concatenate(([0], np.cumsum([len(d) for d in data])))
        got, counts, runs = P.slice_runs(np.frombuffer(b"".join(data), np.uint8), off, least, repeats)
        for t, g, n, r in zip(texts, got, counts, runs):
            want = brute(t, least, repeats)
            assert r == want and n == len(t), (round_, least, repeats)
            gone = {i for s, length, p in want for i in range(s + p, s + length)}
            assert g.decode() == " ".join(w for i, w in enumerate(t) if i not in gone)
            assert P.exact_runs([w.encode() for w in t], least, repeats) == want


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute(words, 24, 3)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(kept))


def test_query_on_planted_and_odd_documents(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, "\n".join(stretched(rng, list("abcdefghij")))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, "x"), (None, "a " * 40), (None, None), (7, "b " * 30), (7, "b " * 30)]
    rows += [(600 + i, "c d e " * (300 + 900 * (i == 3))) for i in range(20)]  # some are planted
    path = tmp_path / "documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("h", F.lit("clash")).withColumn("runs", F.lit(2)).write.parquet(str(path))
    got = [tuple(r) for r in P.op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted((expected(*r) for r in rows), key=repr)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 9
    assert P.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
