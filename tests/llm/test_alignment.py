"""Alignment of two tokenizers against a brute-force version on whole texts."""

import bisect
import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veritrail.llm import alignment as L

ODD = ["", None, " ", "hello  world", "a\tb\nc \r\n d", "x▁y and more", "</s> <s> <unk> <0x0A>", "\x00a", "é é ́", "a\xa0b c　d", "日本語 テキスト", " lead", "trail ", "🙂🙂 ok", "a<|endoftext|>b <|endoftext|>", "=" * 100 + " " * 37 + "1234567", "don't we'll", "� ​ x"]


def letters():
    shown = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    out, k = {chr(b): b for b in shown}, 0
    for b in range(256):
        if b not in shown:
            out[chr(256 + k)] = b
            k += 1
    return out


def brute(rows):
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte = letters()

    def spelt(p):
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    docs, count = [], collections.Counter()
    for doc_id, text in rows:
        ta = tb = []
        if text:
            e = a.encode(" " + text, add_special_tokens=False)
            ta = [(i, bytes(byte[c] for c in t)) for i, t in zip(e.ids, e.tokens)]
            tb = [(i, spelt(b.id_to_piece(i))) for i in b.encode(text)]
            whole = (" " + text).encode()
            if b"".join(x for _, x in ta) != whole or b"".join(x for _, x in tb) != whole:
                ta = tb = []
        ends = [[], []]
        for side, tokens in enumerate((ta, tb)):
            at = 0
            for _, x in tokens:
                at += len(x)
                ends[side].append(at)
        joint = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in joint]
        for side, tokens in enumerate((ta, tb)):
            for (i, _), end in zip(tokens, ends[side]):
                groups[bisect.bisect_left(joint, end)][side].append(i)
        links = collections.Counter((x, y) for g in groups for x in g[0] for y in g[1])
        count.update(links.keys())
        docs.append((doc_id, len(ta), len(tb), groups, links))
    top = collections.defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for doc_id, n_a, n_b, groups, links in docs:
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        best = sum(n for p, n in links.items() if count[p] == top[p[0]])
        out.append((doc_id, n_a, n_b, len(groups), sum(links.values()), best, sum(n * count[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if text else "", text))
    return out


def rows_of(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghé日🙂-'1 ") for _ in range(rng.randrange(1, 12)))
    rows = [(i, "".join(word() + rng.choice([" ", " ", " ", "\n", "  ", ", "]) for _ in range(rng.randrange(1, 60)))) for i in range(120)]
    return rows + list(enumerate(ODD, 1000)) + [(None, "no id"), (None, None), (7, "twice and again"), (7, "twice and again")]


def test_alignment(spark, tmp_path, monkeypatch):
    rows = rows_of(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chunk", F.lit("clash")).withColumn("pair", F.lit(1)).withColumn("n", F.lit(2))
    want = brute(rows)
    got = [tuple(r) for r in L.align(df.repartition(5), with_groups=True).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in L.op13_alignment(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted((r[:-1] for r in want), key=repr)
    assert L.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [tuple(r)[1:8] for r in L.align(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_many_chunks(spark):
    rows = [(i, f"chunk words number {i % 7} and a tail, don't {i}") for i in range(40)] + [(100, "long " * 3000)]
    kept = L.CHUNK
    try:
        L.CHUNK = 200  # the chunks of a task; workers get the function by value only if it isn't importable, so call it here
        import pyarrow as pa

        from veritrail.llm.common import slices, utf8

        pair = L.pair_of(*L.default_vocabularies())
        raw, off = utf8(pa.array([t for _, t in rows]))
        found, totals = [], collections.Counter()
        for k, (lo, hi) in enumerate(slices(off, L.CHUNK)):
            docs, pairs = L.chunk_rows(pair, k, pa.array([r[0] for r in rows[lo:hi]], pa.int64()), raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], True)
            found += docs.to_pylist()
            for r in pairs.to_pylist():
                totals[r["pair"]] += r["n"]
        assert k > 5
    finally:
        L.CHUNK = kept
    want = brute(rows)
    assert [(r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups"]) for r in found] == [(w[0], w[1], w[2], w[3], w[4], w[8]) for w in want]
    assert max(totals.values()) == 40


def test_pieces_are_encoded_some_at_a_time(monkeypatch):
    pair = L.Pair(*L.default_vocabularies())
    texts = [f" word{i} and" for i in range(50)]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    end = np.cumsum([len(t) for t in texts])
    whole = pair.encode(raw, end - [len(t) for t in texts], end)
    asked, model = [], pair.b
    pair.b = type("Counted", (), {"encode": lambda self, found, **more: asked.append(len(found)) or model.encode(found, **more)})()
    monkeypatch.setattr(L, "BATCH", 8)
    parts = pair.encode(raw, end - [len(t) for t in texts], end)
    assert max(asked) == 8 and sum(asked) == 50 and all((x == y).all() for x, y in zip(whole, parts))
