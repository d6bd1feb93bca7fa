import random
import re
import unicodedata

from veritrail.functions import similarity
from veritrail.operators import grid


def loop(query, short, long):
    """Points of one row, term by term and word by word."""
    fold = lambda t: "".join(c for c in unicodedata.normalize("NFD", t or "") if not unicodedata.category(c).startswith("M")).lower()
    short, long, points = fold(short), fold(long), 0
    words = set(re.findall(r"[^\W_]+", short))
    terms = list(dict.fromkeys(re.findall(r"[^\W_]+", fold(query))))
    for t in terms:
        k = 0 if len(t) < 5 else 1 if len(t) < 9 else 2
        if t in short:
            points += 3
        elif k and any(similarity.osa(t, w, k) <= k or (len(w) > len(t) and similarity.osa(t, w[: len(t)], k) <= k) for w in words):
            points += 2
        elif t in long:
            points += 1
        else:
            return None
    return points if terms else None


def test_search_equals_the_loop(spark):
    rng = random.Random(9)
    base = ["trial", "randomised", "controlled", "placebo", "Überwachung", "study", "effectiveness", "a", "über", "x" * 30, "heart", "headache2"]

    def spoilt(w):
        w = list(w)
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(w) + 1)
            kind = rng.randrange(4)
            if kind == 0:
                w.insert(i, rng.choice("aebx"))
            elif kind == 1 and len(w) > 1:
                w.pop(i - 1)
            elif kind == 2 and 0 < i < len(w):
                w[i - 1], w[i] = w[i], w[i - 1]
            elif i < len(w):
                w[i] = rng.choice("aebx")
        return "".join(w) + rng.choice(["", "", "ing", "ness of"])

    text = lambda n: " ".join(spoilt(rng.choice(base)) for _ in range(rng.randrange(n)))
    rows = [(i, text(6), rng.choice([None, "Journal of headaches"]), text(20)) for i in range(300)] + [(900, None, None, None), (901, "", "", "")]
    df = spark.createDataFrame(rows, "key int, title string, journal string, abstract string")
    index = grid.search_index(df, "key", ["title", "journal"])
    for query in ["trail", "randomized trial", "efectivenes", "uberwachung study", "x" * 28 + "yx", "heart head", "Placebo, controled!", "", "??"]:
        got = {r.key: r.points for r in grid.searched(df, query, ["title", "journal"], "abstract", "key", index).collect()}
        want = {k: p for k, t, j, a in rows if (p := loop(query, " \x01 ".join(x for x in (t, j) if x is not None), a)) is not None}
        assert got == want, query
