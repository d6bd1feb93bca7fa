import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from veritrail.functions import canonical, numbers, similarity, spans, statistics, text


def values(spark, rows, expr, kind="v string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, {kind}").orderBy("i").select(expr(F.col(kind.split()[0]))).collect()]


def test_identifiers(spark):
    assert values(spark, [" https://DOI.org/10.1/X ", "doi: 10.1/y", "www.doi.org/10.1/z", "", None, "doi:"], text.canonical_doi) == ["10.1/x", "10.1/y", "www.doi.org/10.1/z", None, None, None]
    assert values(spark, ["http://dx.doi.org/10.1/X"], text.bare_doi) == ["10.1/X"]
    assert values(spark, ["PMC 12", "x", None], text.pmcid) == ["PMC12", None, None]
    assert values(spark, ["nct01234567 and NCT01234567, 2004-000001-12"], text.registry_ids) == [["NCT01234567", "2004-000001-12"]]
    assert values(spark, ["in 1799, 1805", "12005", "2021-05"], text.year_in) == [1805, None, 2021]


def test_names(spark):
    assert values(spark, [["Smith, J"], ["Smith JA"], ["J Smith"], ["Cher"], [], None, ["O'Neil T"]], text.first_family, "v array<string>") == ["Smith", "Smith", "Smith", "Cher", None, None, "ONeil"]
    assert values(spark, ["A B; C D", "Smith J, Doe AB", "Smith, John", ""], text.split_authors) == [["A B", "C D"], ["Smith J", "Doe AB"], ["Smith, John"], []]
    assert values(spark, ["  Ä-rger_1, the  END "], text.plain_title) == ["ä rger_1 the end"]
    assert values(spark, ["treatments", "boxes", "es", "ran"], text.stem) == ["treatment", "box", "es", "ran"]
    assert values(spark, ["a b/c (d)", "!!!", None], text.row_key) == ["a_b_c_d", "row", "row"]
    assert values(spark, ["Café ÀÉ  x"], text.fold_accents) == ["cafe ae x"]


def test_normalizers(spark):
    names = ["trim", "numeric_punctuation"]
    assert values(spark, ["1,234.5", "1.234,5", "1,5", "1,2,3", "1.2.3", None], lambda c: text.normalize(c, names)) == ["1234.5", "1234.5", "1.5", "123", "123", ""]
    assert values(spark, [" $ 5 %"], lambda c: text.normalize(c, ["currency_symbol", "percent_symbol"])) == ["5"]


def test_markup_and_messages(spark):
    assert values(spark, ["<p>a &amp;lt; b</p>\n c", "<br/>"], text.strip_markup) == ["a &lt; b c", None]
    assert values(spark, ['{"error":{"message":"no  way"}}', "plain", "<html>x", '{"detail":"d"}'], text.message_of) == ["no way", "plain", None, "d"]
    assert values(spark, ['<think>x {y}</think>```json\n{"a":1}\n```', '{"a":1} more'], text.answer_json) == ['{"a":1}', None]
    assert values(spark, ["1.9", "2"], text.next_label) == ["1.10", "3"]
    assert spark.range(1).select(text.label_after(F.lit("1.10"), F.lit("1.9"))).first()[0]
    assert values(spark, [{"a": [0, 2], "b": [1]}], text.from_inverted_index, "v map<string,array<int>>") == ["a b a"]


def test_parse_value(spark):
    parse = lambda rows, **k: [tuple(r)[:2] for r in values(spark, rows, lambda c: numbers.parse_value(c, numbers.Scalar(**k)))]
    assert parse(["1,234.50", "−3", "nr", "1,23", " ", None], kind="decimal", group_mark=",") == [("1234.50", "extracted"), ("-3", "extracted"), (None, "missing"), (None, "invalid"), (None, "missing"), (None, "missing")]
    assert parse(["12 %", "n=5"], kind="percentage") == [("12", "extracted"), (None, "invalid")]
    assert parse(["n=5", "6"], kind="integer", prefix="n=") == [("5", "extracted"), (None, "invalid")]
    assert parse(["9007199254740993", "5.0", "5.5"], kind="integer") == [(None, "invalid"), ("5", "extracted"), (None, "invalid")]
    assert parse(["Yes", "NA"], kind="boolean") == [("true", "extracted"), (None, "invalid")]
    assert parse(["2026-02-30", "2026-02-03"], kind="date") == [(None, "invalid"), ("2026-02-03", "extracted")]


def test_comparisons(spark):
    rows = [("numeric", "100", "100.5", 0.5, None, True), ("numeric", "100", "101", None, 0.01, True), ("numeric", "0", "0.1", None, 0.5, False), ("numeric", "x", "1", 1.0, None, False), ("date", "2026-09-02", "02.09.2026", None, None, True), ("boolean", "yes", "1", None, None, True), ("exact", "a", "A", None, None, False)]
    df = spark.createDataFrame(rows, "op string, e string, a string, abs double, rel double, want boolean")
    assert df.where(numbers.agrees(F.col("e"), F.col("a"), F.col("op"), F.col("abs"), F.col("rel")) != F.col("want")).count() == 0
    same = [("1.0", "1", True), ("A  b", "a B", True), (None, None, True), (None, "1", False)]
    assert spark.createDataFrame(same, "a string, b string, w boolean").where(numbers.same_value(F.col("a"), F.col("b")) != F.col("w")).count() == 0
    assert values(spark, ["12 (34.5%)", "12"], lambda c: numbers.component(c, "count_percent", "percent")) == ["34.5", None]
    assert values(spark, ["1.2 (0.9, 1.6)"], lambda c: numbers.component(c, "estimate_interval", "upper")) == ["1.6"]


def test_similarity():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for c in a:
            new = [0]
            for j, d in enumerate(b, 1):
                new.append(row[j - 1] + 1 if c == d else max(row[j], new[-1]))
            row = new
        return row[-1]

    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(25)]
    assert all(similarity.lcs(a, b) == lcs(a, b) for a, b in itertools.product(words, words))
    assert similarity.ratio("", "") == 100 and similarity.token_sort("b a", "a b") == 100 and similarity.token_set("a b", "b a c") == 100
    assert similarity.osa("ab", "ba", 2) == 1 and similarity.osa("abc", "xyz", 1) == 2 and similarity.partial("bcd", "abcde")[0] == 100


def test_statistics():
    assert math.isclose(statistics.clopper_pearson(10, 10)[0], 0.05**0.1, rel_tol=1e-9)
    assert math.isclose(statistics.clopper_pearson(0, 10)[1], 1 - 0.05**0.1, rel_tol=1e-9)
    assert math.isclose(statistics.clopper_pearson(10, 10, sided="two")[0], 0.025**0.1, rel_tol=1e-9)
    assert statistics.recall_needed(0.975) == 119 and statistics.recall_needed(0.975, sided="two") == 146
    exact = lambda k, n, m, d: sum(math.comb(m, i) * math.comb(n - m, d - i) for i in range(k + 1)) / math.comb(n, d)
    assert all(math.isclose(statistics.hypergeometric_cdf(k, 20, 8, 6), exact(k, 20, 8, 6), rel_tol=1e-9) for k in range(6))
    assert statistics.elusion([(50, 50, 3)]) == (3, 3, 3) and statistics.elusion([]) == (0, 0, 0)
    with pytest.raises(ValueError):
        statistics.elusion([(10, 0, 0)])
    lo, hi = statistics.hypergeometric_bounds(30, 10, 2, 0.05)
    inside = [k for k in range(2, 31) if 1 - statistics.hypergeometric_cdf(1, 30, k, 10) > 0.05 and statistics.hypergeometric_cdf(2, 30, k, 10) > 0.05]
    assert (lo, hi) == (inside[0], inside[-1])
    assert statistics.chapman(50, 40, 0)[2] == math.inf and statistics.chapman(50, 40, 20)[0] == 51 * 41 / 21 - 1
    assert statistics.stop_p([True] * 5, 0, 0.9) == 0 and statistics.stop_p([True] + [False] * 9, 90, 0.95) > 0.5
    assert statistics.conformal_order(119, 0.975, 0.05) == 1
    with pytest.raises(ValueError):
        statistics.conformal_order(50, 0.975, 0.05)


def test_canonical_json(spark):
    assert canonical.canonical({"b": 1.0, "a": [1e21, 1e-7, 0.001, True, None, "é\n"]}) == '{"a":[1e+21,1e-7,0.001,true,null,"é\\n"],"b":1}'
    assert canonical.leaves({"a/b": [1, {}], "~": None}) == [("/a~1b/0", "1"), ("/a~1b/1", "{}"), ("/~0", "null")]
    assert values(spark, ['{"b":1,"a":2}', "no", None], canonical.canonical_json) == ['{"a":2,"b":1}', None, None]


def test_spans(spark):
    assert spans.find_quote("ab cd", "x ab\n cd ab­ cd") == [(2, 8), (9, 15)]
    assert spans.whole_tokens("1.2", "11.2 and 1.2, 1.25") == [(9, 12)]
    t = "AIM: a. METHODS: b."
    got = values(spark, [t, None], spans.sections)
    assert [(s.tag, t[s.start : s.end].strip()) for s in got[0]] == [("AIM", "AIM: a."), ("METHODS", "METHODS: b.")] and got[1] == []
    assert [(h.start, h.tag) for h in values(spark, ["trial trials Trial"], spans.highlights({"k": ["trial"]}))[0]] == [(0, "k"), (13, "k")]
