"""The pipeline and each of its stages, on their own input, against brute-force versions."""

import collections
import random
import re
import zlib

import corpus_pipeline as P

from veritrail.llm.common import materialize
from veritrail.llm.mixing import TARGETS, mixing_rates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def kept_by_rules(rows):
    """Rows that pass their own rules; the hosts of these tests pass theirs."""
    out = []
    for r in rows:
        w = WORD.findall(r[1] or "")
        c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        if len(w) >= 50 and 100 * len(covered) <= 50 * len(w):
            out.append(r)
    return out


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def one_of_each_group(rows):
    """The row of the least doc_id (null last) of each group of linked rows."""
    sets, up = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                up[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i, r in enumerate(rows):
        groups[root(i)].append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def clean(rows, items):
    norm = lambda t: " ".join((t or "").lower().split())
    return [r for r in rows if not any(edits(norm(i), norm(r[1])) <= int(len(norm(i)) * 0.05) for i in items)]


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def made(seed=3):
    """Rows with copies, near copies, benchmark passages, short texts, and null and repeated ids."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7)))
    body = lambda n: [word() for _ in range(n)]
    items = [" ".join(body(12)) for _ in range(3)]
    rows = []
    for i in range(24):
        w = body(70)
        rows.append((i, " ".join(w)))
        if i % 4 == 0:
            rows.append((100 + i, " ".join(w)))
            w[35] = "changed"
            rows.append((200 + i, " ".join(w)))
        if i % 6 == 1:
            rows.append((300 + i, " ".join(body(40) + [items[i % 3]] + body(20))))
    one = " ".join(body(60))
    rows += [(1, "two words"), (1, " ".join(body(60))), (None, one), (None, one), (None, "short"), (None, " ".join(body(55))), (4, one + " more"), (7, None), (8, "")]
    return [(d, t, "en", f"s{(d or 0) % 2}", len(t or "")) for d, t in rows], items


def test_stages_by_brute_force(spark, sf, tmp_path):
    rows, items = made()
    spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(24)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, at = spark.createDataFrame(rows, COLUMNS), str(tmp_path)
    want = kept_by_rules(rows)
    docs = materialize(P.quality(spark, docs, at), "test")
    assert plain(docs) == sorted(want, key=repr) and len(want) == len(rows) - 4
    want = one_of_each_group(want)
    docs = materialize(P.near_duplicates(spark, docs, at), "test")
    assert plain(docs) == sorted(want, key=repr) and [r[0] for r in want].count(None) == 1
    want = clean(want, items)
    docs = materialize(P.decontamination(spark, docs, at), "test")
    assert plain(docs) == sorted(want, key=repr) and 20 < len(want) < docs.count() + 5
    rates = {(r.doc_id, r._key): r.rate for r in mixing_rates(docs, spark.read.parquet(f"{at}/labels.parquet"), TARGETS).collect()}
    before = collections.Counter(map(tuple, docs.collect()))
    docs = materialize(P.mixing(spark, docs, at), "test")
    after = collections.Counter(map(tuple, docs.collect()))
    assert docs.columns == COLUMNS.replace(" long", "").replace(" string", "").split(", ") and set(after) <= set(before)
    assert abs(sum(after.values()) - sum(rates.values())) <= len(rates)
    got = P.tokens(spark, docs, at).collect()
    from public_tokenizers import path
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(path("byte_bpe_50k.json")).encode
    ids = lambda t: encode(t or "", add_special_tokens=False).ids + [0]
    crc = lambda x: zlib.crc32(b"".join(i.to_bytes(4, "little") for i in x))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((r[0] is None, r[0] or 0, len(ids(r[1])), crc(ids(r[1]))) for r in after.elements())


def test_stages_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in P.STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf), "test")
        if stage is not P.STAGES[-1][1]:
            assert docs.columns == columns
        assert docs.count() > 0.7 * before.count()


def test_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = materialize(stage(spark, docs, sf), "test")
        assert docs.count() == 0
