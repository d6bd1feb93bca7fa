"""Alike titles: nothing is lost where titles share words, are long, or only some of them are to be met."""

import hashlib
import itertools
import random

import numpy as np

from veritrail.functions import similarity
from veritrail.operators import alike


def brute(titles):
    return {tuple(sorted(p)) for p in itertools.combinations(sorted(set(titles)), 2) if similarity.ratio(*p) >= 90}


def changed(rng, title, times, letters):
    t = list(title)
    for _ in range(times):
        if rng.random() < 0.5 and t:
            del t[rng.randrange(len(t))]
        else:
            t.insert(rng.randrange(len(t) + 1), rng.choice(letters))
    return "".join(t).strip()


def test_a_word_of_all_titles_is_no_key(spark):
    """Titles that end with one word: a segment of it met every title with every other one."""
    rng = random.Random(3)
    base = [f"{hashlib.md5(str(i).encode()).hexdigest()[:24]} keynote" for i in range(300)]
    titles = base + [changed(rng, t, rng.randrange(1, 8), "0123456789abcdef ") for t in base]
    n = len(base[0])
    parts, kept = alike.planned(base, n, 90)
    places, sizes = alike.segments(n, parts)
    assert len(kept) == alike.most_edits(n, 90) + 1 and not any("keynote".find(base[0][places[i] : places[i] + sizes[i]]) >= 0 for i in kept)
    got = {(r.a, r.b) for r in alike.alike_titles(spark.createDataFrame([(t,) for t in titles], "title string")).collect()}
    assert got == brute(titles) and len(got) > 200


def test_long_titles_meet_in_tiles(spark, monkeypatch):
    """Prose longer than SHORT, beside titles around that length, in chunks of a few titles."""
    monkeypatch.setattr(alike, "CHUNK", 7)
    rng = random.Random(4)
    words = [w for n in (2, 3, 5) for w in ("".join(rng.choice("etaoinshé") for _ in range(n)) for _ in range(12))]
    base = [" ".join(sorted(rng.choice(words) for _ in range(k))) for k in (9, 11, 12, 13, 30, 60, 120) for _ in range(4)]
    titles = base + [changed(rng, t, rng.randrange(1, len(t) // 5), "etaoin ") for t in base for _ in range(2)]
    got = {(r.a, r.b): r.score for r in alike.alike_titles(spark.createDataFrame([(t,) for t in titles], "title string")).collect()}
    assert set(got) == brute(titles) and len(got) > 30 and all(s == similarity.ratio(*p) for p, s in got.items())
    assert any(len(a) <= alike.SHORT < len(b) or len(b) <= alike.SHORT < len(a) for a, b in got)


def test_only_pairs_with_a_lone_title_of_the_block(spark):
    long = "x" * 60
    rows = [("abcdefghij", 1, True), ("abcdefghijk", 1, False), ("abcdefghijl", 1, False), ("abcdefghijm", 2, True), (long, 1, False), (long + "y", 1, True), (long + "z", 1, False)]
    got = {(r.a, r.b) for r in alike.alike_titles(spark.createDataFrame(rows, "title string, block int, lone boolean")).collect()}
    assert got == {("abcdefghij", "abcdefghijk"), ("abcdefghij", "abcdefghijl"), (long, long + "y"), (long + "y", long + "z")}


def test_a_score_ends_early_only_below_the_least():
    rng = random.Random(5)
    for _ in range(400):
        a = "".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 150)))
        b = changed(rng, a, rng.randrange(1 + len(a) // 4), "abcd ")
        whole = similarity.ratio(a, b)
        assert similarity.ratio_within(a, similarity.letter_places(a), b, 90) == (whole if whole >= 90 else None)


def test_many_scores_side_by_side():
    rng = random.Random(6)
    titles = ["".join(rng.choice("abcdé ") for _ in range(rng.choice((1, 7, 8, 9, 63, 64, 65, 130)))) for _ in range(60)] + [""]
    packed = [similarity.packed_places(t) for t in titles]
    for b in titles:
        assert similarity.lcs_of_many(b, packed).tolist() == [similarity.lcs(t, b) for t in titles]


def test_scores_side_by_side_end_early_only_below_the_least(monkeypatch):
    rng = random.Random(7)
    monkeypatch.setattr(similarity.Beside, "KEPT", 4)
    for letters in ("abcd ", "ab", "etaoinshé "):
        base = ["".join(rng.choice(letters) for _ in range(rng.choice((1, 40, 63, 64, 200, 460, 500)))) for _ in range(8)]
        titles = [t for t in (*base, *(changed(rng, t, rng.randrange(1 + len(t) // 4), letters) for t in base for _ in range(6))) if t]
        beside = similarity.Beside(titles)
        for b in titles:
            rows = np.array(sorted(rng.sample(range(len(titles)), 20)))
            assert beside.ratios_within(b, np.arange(len(titles)), 90) == [(i, r) for i, t in enumerate(titles) if (r := similarity.ratio(t, b)) >= 90]
            assert beside.ratios_within(b, rows, 90) == [(i, r) for i in rows.tolist() if (r := similarity.ratio(titles[i], b)) >= 90]


def test_halves_refuse_no_alike_titles_and_most_others(monkeypatch):
    """Long prose of one language has much the same letters: most pairs of it were scored, each as far as its end."""
    rng = random.Random(9)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    base = [" ".join(sorted(rng.choice(words) for _ in range(k))) for k in (9, 30, 31, 60, 61, 100) for _ in range(12)]
    titles = sorted({*base, *(changed(rng, t, rng.randrange(1, len(t) // 5), "etaoin ") for t in base for _ in range(2))})
    rows = [(len(t), t, True) for t in titles if len(t) > alike.SHORT]
    scored = []
    one, many = similarity.ratio_within, similarity.Beside.ratios_within
    monkeypatch.setattr(similarity, "ratio_within", lambda a, places, b, least: scored.append(1) or one(a, places, b, least))
    monkeypatch.setattr(similarity.Beside, "ratios_within", lambda self, b, rows, least: scored.extend(rows) or many(self, b, rows, least))
    got = {(a, b): s for a, b, s in alike._near(rows, rows, 90, True)}
    assert set(got) == brute([r[1] for r in rows]) and len(got) > 60 and all(s == similarity.ratio(*p) for p, s in got.items())
    counts, n = alike._counted(rows)[0].T.astype(int), [r[0] for r in rows]
    lettered = sum(abs(counts[i] - counts[j]).sum() <= (n[i] + n[j]) / 10 for i, j in itertools.combinations(range(len(rows)), 2))
    assert 2 * len(scored) < lettered


def test_segments_stand_in_few_places():
    """Every kept segment was looked for as far as all edits move it: 250 keys and more of a title of 34 characters."""
    plans = {n: (alike.most_edits(n, 90) + 2, tuple(range(alike.most_edits(n, 90), -1, -1))) for n in range(28, 39)}
    assert len(alike._places_of_segments(34, plans, 90)[0]) < 80


def test_short_titles_of_two_letters_lose_nothing(spark):
    """Edits at both ends and in runs, in titles whose segments stand in many places."""
    rng = random.Random(11)
    titles = set()
    for _ in range(60):
        base = "".join(rng.choice("ab") for _ in range(rng.randrange(8, 49)))
        titles.add(base)
        for _ in range(5):
            k = rng.randrange(1, 5)
            at = rng.choice((0, rng.randrange(len(base)), len(base) - k))
            cut = base[:at] + base[at + k :] if rng.random() < 0.5 else base
            put = rng.choice((0, rng.randrange(len(cut) + 1), len(cut)))
            titles.add(cut[:put] + "".join(rng.choice("ab") for _ in range(rng.randrange(4))) + cut[put:])
    got = {(r.a, r.b) for r in alike.alike_titles(spark.createDataFrame([(t,) for t in sorted(titles)], "title string")).collect()}
    assert got == brute(titles) and len(got) > 300
