"""Packing: ids against the tokenizers library, plans against the bound and against best fit alone, odd tables."""

import collections
import random
import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veritrail.llm import packing as K

ODD = ["", None, "don't STOP", "a<|endoftext|>b", "x1234 y", "Σας ΟΔΟΣ", "é é ́x", "a\xa0b \x1c q", "l'été, n'est-ce pas?", "日本 語", "...--- '' 's", "A" * 300, "\x00 a\x7fb", "  lead trail \n", "ﬁ İstanbul", "'ll 'LL x'Ve", "<|startoftext|>  x　y", "x\u0085y"]


def check_plan(pieces, capacity, runs, sequences):
    """Every piece has one place, sequences are gapless and within the capacity."""
    numbers, places = collections.defaultdict(list), collections.defaultdict(list)
    for length, lo, hi, first, each, at in runs:
        for nth in range(lo, hi):
            numbers[length].append(nth)
            places[first + (nth - lo) // each].append((at + (nth - lo) % each * length, length))
    assert {k: v for k, v in pieces.items() if v} == {k: len(v) for k, v in numbers.items()}
    assert all(sorted(v) == list(range(len(v))) for v in numbers.values())
    assert sorted(places) == list(range(sequences))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity


def plain_best_fit(pieces, capacity):
    left = []
    for length, n in sorted(pieces.items(), reverse=True):
        for _ in range(n):
            fits = [(r, i) for i, r in enumerate(left) if r >= length]
            if fits:
                left[min(fits)[1]] -= length
            else:
                left.append(capacity - length)
    return len(left)


def test_plans_of_many_mixes():
    rng = random.Random(2)
    for k in range(40):
        capacity = rng.choice([10, 50, 100, 2048])
        top = rng.choice([capacity, max(1, capacity // 2), max(1, capacity // 9)])
        pieces = {rng.randrange(1, top + 1): rng.choice([1, 2, 7, 60]) for _ in range(rng.randrange(0, 40))}
        runs, n = K.plan(pieces, capacity)
        check_plan(pieces, capacity, runs, n)
        least = -(-sum(a * b for a, b in pieces.items()) // capacity)
        assert least <= n <= plain_best_fit(pieces, capacity) + max(2, least // 20), (k, n, least)


def test_parts_of_a_plan():
    groups = K.linear_groups([(100, 3), (90, 5), (80, 1), (70, 3)], 4)
    assert groups == [[(100, 3)], [(90, 5), (80, 1)], [(70, 3)]]  # two groups of one length, 90, are one
    assert K.best_configuration(np.array([0.5, 0.34]), [50, 33], 100).tolist() == [0, 3]
    assert K.best_configuration(np.array([0.5, 0.3]), [50, 33], 100).tolist() == [2, 0]
    found = K.configurations([60, 40], [10, 10], 100)
    assert sorted((c.tolist(), n) for c, n in found) == [([1, 1], 10)]
    room = K.Room(100)
    room.best_fit(30, 7)  # three, three, one
    room.best_fit(60, 2)
    room.best_fit(10, 3)
    check_plan({30: 7, 60: 2, 10: 3}, 100, room.runs, room.opened)
    assert room.opened == 4


def test_query(spark, tmp_path):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgé1.,'") for _ in range(rng.randrange(1, 9)))
    rows = [(i, " ".join(word() for _ in range(rng.choice([3, 40, 300, 900])))) for i in range(150)]
    rows += list(enumerate(ODD, 1000)) + [(None, "no id"), (None, None), (7, "twice"), (7, "twice"), (5000, "ab " * 9000), (5001, "x " * 2047), (5002, "x " * 2048)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("clash")).withColumn("length", F.lit(1)).withColumn("n", F.lit(2))
    df.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = K.op12_packing(spark, str(tmp_path)).collect()
    library = Tokenizer.from_file(K.default_vocabulary())
    want = collections.Counter()
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        for piece in range(-(-len(ids) // 2048)):
            own = ids[piece * 2048 : piece * 2048 + 2048]
            want[(doc_id, piece, piece * 2048, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))] += 1
    assert collections.Counter(tuple(r[:5]) for r in got) == want
    held = collections.defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(held) <= -(-sum(r.length for r in got) // 2048) + 1
    assert K.pack(K.pieces_of(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_ids_are_kept(spark):
    out = K.pack(K.pieces_of(spark.createDataFrame([(1, "to be or not to be"), (2, "x " * 50)], "doc_id long, text string"), capacity=16), capacity=16).collect()
    library = Tokenizer.from_file(K.default_vocabulary())
    ids = np.concatenate([np.frombuffer(bytes(r.ids), "<u4") for r in sorted(out, key=lambda r: (r.doc_id, r.piece))])
    assert ids.tolist() == library.encode("to be or not to be", add_special_tokens=False).ids + [0] + library.encode("x " * 50, add_special_tokens=False).ids + [0]


def test_words_are_kept_beyond_the_bound_of_token_output():
    """A worker that met more words than token output keeps still knows them; ids don't depend on what is kept."""
    from veritrail.llm import token_output

    coder = K.WordEncoder(K.default_vocabulary())
    assert coder.keep > token_output.KEEP == token_output.Encoder.keep
    raw, off = np.frombuffer(b"one two three one", np.uint8), np.array([0, 17])
    first, _ = coder.encode(raw, off, 0)
    coder.keep = 2
    again, _ = coder.encode(raw, off, 0)
    assert len(coder.h1) == 3 and first.tolist() == again.tolist()
