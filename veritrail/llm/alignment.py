"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how many documents hold each pair linked.

A document is a space and its text. Byte offsets where tokens of both sides end cut them into groups, and all pairs of a
group are links. A task goes through its documents in chunks. A chunk's texts are cut at single spaces
between two other characters, where both tokenizers always cut (no token of either has a space behind another character), so a
document is a sequence of pieces, and pieces come back often. DuckDB works on interval tables of the chunk's
distinct pieces, end to end on one axis of bytes: an ASOF join finds the B token that covers an A token's end, a window sum of
the joint ends numbers the groups, a range join puts the B tokens into the groups' bytes, and joins give links and the
pairs that each document holds. Spark merges the chunks' partial pair counts, and sends each chunk the counts of its own pairs.

Defined cases: a null or empty text, or one whose tokens of either side don't give back its bytes (U+2581, say), has no
tokens: zeros, and an empty string of groups; repeated rows are rows of their own, and each counts as a document; null doc_ids
stay null; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import materialize, slices, table, utf8, word_hashes
from veritrail.llm.token_output import Encoder, piece_starts

ALIGNED = "kind int, chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, held binary, times binary, pair long, n long"
ALIGNED_ARROW = pa.schema(
    [("kind", pa.int32()), ("chunk", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("groups", pa.string()), ("held", pa.binary()), ("times", pa.binary()), ("pair", pa.int64()), ("n", pa.int64())]
)
SCORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"
SCORED_ARROW = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string()), ("groups", pa.string())])
#: Bytes of text in a chunk (or one longer document).
CHUNK = 6 << 20
#: Pieces that are encoded at once.
BATCH = 8192
#: kinds of rows: a document, a chunk's count of one pair
DOCUMENT, PAIR = 0, 1

SPANS = "CREATE TABLE ends AS SELECT a.i, a.piece, a.id, a.s, a.e, b.e = a.e AS joint FROM a ASOF JOIN b ON a.e <= b.e"
GROUPED = "CREATE TABLE ga AS SELECT i, piece, id, s, e, (sum(joint::INT) OVER (ORDER BY e ROWS UNBOUNDED PRECEDING) - joint::INT)::INT AS grp FROM ends"
GROUPS = "CREATE TABLE groups AS SELECT grp, any_value(piece) AS piece, min(s) AS s, max(e) AS e FROM ga GROUP BY grp"
INSIDE = "CREATE TABLE gb AS SELECT b.i, b.id, g.grp FROM b JOIN groups g ON b.s >= g.s AND b.e <= g.e"
LINKS = "CREATE TABLE links AS SELECT piece, ga.id::BIGINT * {size} + gb.id AS pair, count(*) AS n FROM ga JOIN gb USING (grp) GROUP BY ALL"
HELD = "CREATE TABLE held AS SELECT doc, pair, sum(m * n)::BIGINT AS n FROM (SELECT doc, piece, count(*) AS m FROM occurrences GROUP BY ALL) JOIN links USING (piece) GROUP BY ALL"


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """data[start : start + size] of each, end to end."""
    to = np.concatenate(([0], np.cumsum(size)))
    return data[np.arange(to[-1]) + np.repeat(start - to[:-1], size)]


class Spelling:
    """The bytes of each token of a vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def wrong(self, ids: np.ndarray, counts: np.ndarray, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of each piece of raw, whether its ids spell something else."""
        piece = np.repeat(np.arange(len(counts)), counts)
        spelt = np.bincount(piece, self.size[ids], len(counts)).astype(np.int64)
        wrong = spelt != size
        good = ~wrong[piece]
        own = np.flatnonzero(~wrong)
        differ = gathered(self.data, self.start[ids[good]], self.size[ids[good]]) != gathered(raw, start[own], size[own])
        if differ.any():
            wrong[np.repeat(own, size[own])[differ]] = True
        return wrong


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Pair:
    """Both tokenizers, for pieces that begin with a space."""

    def __init__(self, a: str, b: str):
        import sentencepiece

        self.a = Encoder(a)
        self.a.tokenizer.encode_special_tokens = True
        letters = byte_letters()
        spelt = {i: t for t, i in self.a.tokenizer.get_vocab().items()}
        self.spell_a = Spelling([bytes(letters.get(c, 63) for c in spelt[i]) for i in range(self.a.size)])
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        self.size_b = self.b.get_piece_size()
        self.spell_b = Spelling([bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in range(self.size_b) for p in [self.b.id_to_piece(i)]])
        digits = [str(i).encode() for i in range(max(self.a.size, self.size_b))]
        self.digits = Spelling(digits)

    def encode(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of A, their numbers, ids of B, their numbers) of pieces of raw. B puts a space before a text itself."""
        ids_a, n_a = self.a._encode(raw, start, end)
        data = raw.tobytes()
        ids_b, n_b = [np.zeros(0, np.int32)], np.zeros(len(start), np.int64)
        for lo in range(0, len(start), BATCH):  # lists of ids are large: some pieces at a time
            found = self.b.encode([data[x + 1 : y].decode() for x, y in zip(start[lo : lo + BATCH].tolist(), end[lo : lo + BATCH].tolist())], num_threads=1)
            n_b[lo : lo + BATCH] = own = [len(f) for f in found]
            ids_b.append(np.fromiter((i for f in found for i in f), np.int32, sum(own)))
        return ids_a, n_a.astype(np.int64), np.concatenate(ids_b), n_b


_PAIRS: dict[tuple[str, str], Pair] = {}


def pair_of(a: str, b: str) -> Pair:
    """One for each worker process."""
    if (a, b) not in _PAIRS:
        _PAIRS[a, b] = Pair(a, b)
    return _PAIRS[a, b]


def spelt_groups(pair: Pair, ids_a: np.ndarray, grp_a: np.ndarray, ids_b: np.ndarray, grp_b: np.ndarray, groups: int) -> tuple[bytes, np.ndarray]:
    """`a1,a2|b1;a3|b2,b3;` of all groups, and where each group ends in it."""
    n_a, n_b = np.bincount(grp_a, minlength=groups), np.bincount(grp_b, minlength=groups)
    end_a, end_b = np.cumsum(n_a), np.cumsum(n_b)
    ids = np.empty(len(ids_a) + len(ids_b), np.int64)
    sign = np.full(len(ids), ord(","), np.uint8)
    ids[np.arange(len(ids_a)) + (end_b - n_b)[grp_a]] = ids_a
    ids[np.arange(len(ids_b)) + end_a[grp_b]] = ids_b
    sign[end_a + end_b - n_b - 1] = ord("|")
    sign[end_a + end_b - 1] = ord(";")
    size = pair.digits.size[ids]
    to = np.cumsum(size + 1)
    out = np.empty(int(to[-1]) if len(to) else 0, np.uint8)
    is_sign = np.zeros(len(out), bool)
    is_sign[to - 1] = True
    out[is_sign] = sign
    out[~is_sign] = gathered(pair.digits.data, pair.digits.start[ids], size)
    return out.tobytes(), to[end_a + end_b - 1] if groups else to[:0]


def spaced(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text that isn't empty with a space before it."""
    size = np.diff(off)
    lead = (size > 0).astype(np.int64)
    to = np.concatenate(([0], np.cumsum(size + lead)))
    out = np.full(int(to[-1]), 32, np.uint8)
    body = np.ones(len(out), bool)
    body[to[:-1][size > 0]] = False
    out[body] = raw
    return out, to


def chunk_rows(pair: Pair, number: int, doc_ids: pa.Array, raw: np.ndarray, off: np.ndarray, with_groups: bool) -> list[pa.RecordBatch]:
    """A row for each document of a chunk (held, times: numbers of its pairs in the chunk's list, and its links of them), and one for each pair."""
    import duckdb

    raw, off = spaced(raw, off)
    docs = len(off) - 1
    start = piece_starts(raw, off)
    end = np.concatenate((start[1:], [len(raw)])).astype(np.int64) if len(start) else start
    names = np.empty(len(start), [("h1", np.uint64), ("h2", np.uint64)])
    names["h1"], names["h2"] = word_hashes(raw, start, end, 41), word_hashes(raw, start, end, 42)
    by = np.lexsort((names["h2"], names["h1"]))
    new = np.concatenate(([True], names[by[1:]] != names[by[:-1]])) if len(by) else np.zeros(0, bool)
    head = by[new]
    whose = np.empty(len(by), np.int64)  # of each piece, its number among the distinct ones
    whose[by] = np.cumsum(new) - 1
    doc = np.searchsorted(off, start, side="right") - 1
    s, e = start[head], end[head]
    del names, by, new, start, end
    ids_a, n_a, ids_b, n_b = pair.encode(raw, s, e)
    wrong = pair.spell_a.wrong(ids_a, n_a, raw, s, e - s) | pair.spell_b.wrong(ids_b, n_b, raw, s, e - s)
    bad = np.zeros(docs, bool)
    bad[doc[wrong[whose]]] = True
    use = ~bad[doc]
    doc, whose = doc[use], whose[use]
    base = np.cumsum(np.where(wrong, 0, e - s))
    piece_a, piece_b = np.repeat(np.arange(len(head)), n_a), np.repeat(np.arange(len(head)), n_b)
    good_a, good_b = ~wrong[piece_a], ~wrong[piece_b]
    ids_a, piece_a, ids_b = ids_a[good_a], piece_a[good_a], ids_b[good_b]
    e_a, e_b = np.cumsum(pair.spell_a.size[ids_a]), np.cumsum(pair.spell_b.size[ids_b])
    con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
    con.register("a_rows", pa.table({"i": np.arange(len(ids_a)), "piece": piece_a.astype(np.int32), "id": ids_a, "s": e_a - pair.spell_a.size[ids_a], "e": e_a}))
    con.register("b_rows", pa.table({"i": np.arange(len(ids_b)), "id": ids_b, "s": e_b - pair.spell_b.size[ids_b], "e": e_b}))
    con.register("occurrences", pa.table({"doc": doc.astype(np.int32), "piece": whose.astype(np.int32)}))
    con.execute("CREATE TABLE a AS FROM a_rows; CREATE TABLE b AS FROM b_rows")
    con.unregister("a_rows"), con.unregister("b_rows")
    for step, done in ((SPANS, "a"), (GROUPED, "ends"), (GROUPS, None), (INSIDE, "b")):  # a table goes when its last reader has run
        con.execute(step)
        if done:
            con.execute(f"DROP TABLE {done}")
    grp_a = con.execute("SELECT grp FROM ga ORDER BY i").fetchnumpy()["grp"]
    grp_b = con.execute("SELECT grp FROM gb ORDER BY i").fetchnumpy()["grp"]
    of_group = con.execute("SELECT piece FROM groups ORDER BY grp").fetchnumpy()["piece"]
    con.execute("DROP TABLE groups")
    con.execute(LINKS.format(size=pair.size_b))
    con.execute("DROP TABLE ga; DROP TABLE gb")
    con.execute(HELD)
    con.execute("DROP TABLE links")
    counts = con.execute("SELECT pair, count(*) AS n FROM held GROUP BY pair ORDER BY pair").fetchnumpy()
    held = con.execute("SELECT doc, pair, n FROM held ORDER BY doc, pair").fetchnumpy()
    con.close()
    groups = len(of_group)
    links = np.bincount(grp_a, minlength=groups) * np.bincount(grp_b, minlength=groups)
    text, cut = spelt_groups(pair, ids_a, grp_a, ids_b, grp_b, groups)
    last = np.searchsorted(of_group, np.arange(len(head)), side="right")  # of each piece, the groups up to its end
    ends = np.concatenate(([0], cut))[last].tolist()
    spelt = [text[x:y] for x, y in zip([0, *ends[:-1]], ends)]
    per_piece = (np.where(wrong, 0, n_a), np.where(wrong, 0, n_b), np.diff(np.concatenate(([0], last))), np.diff(np.concatenate(([0], np.cumsum(links)))[np.concatenate(([0], last))]))
    first = np.searchsorted(doc, np.arange(docs + 1))
    sums = [np.diff(np.concatenate(([0], np.cumsum(values[whose])))[first]) for values in per_piece]
    shas, texts, codes = [], [], whose.tolist()
    for x, y in zip(first[:-1].tolist(), first[1:].tolist()):
        own = b"".join([spelt[k] for k in codes[x:y]])[:-1]
        shas.append(hashlib.sha256(own).hexdigest() if own else "")
        texts.append(own.decode() if with_groups else None)
    edge = (np.searchsorted(held["doc"], np.arange(docs + 1)) * 4).astype(np.int32)
    place = np.searchsorted(counts["pair"], held["pair"]).astype("<u4")
    blobs = [pa.Array.from_buffers(pa.binary(), docs, [None, pa.py_buffer(edge.tobytes()), pa.py_buffer(x.astype("<u4").tobytes())]) for x in (place, held["n"])]
    rows = {"kind": np.full(docs, DOCUMENT), "chunk": np.full(docs, number), "doc_id": doc_ids, "n_a": sums[0], "n_b": sums[1], "n_groups": sums[2], "n_links": sums[3], "groups_sha256": shas, "groups": texts, "held": blobs[0], "times": blobs[1]}
    pairs = {"kind": np.full(len(counts["pair"]), PAIR), "chunk": np.full(len(counts["pair"]), number), "pair": counts["pair"], "n": counts["n"]}
    return [filled(rows, docs), filled(pairs, len(counts["pair"]))]


def filled(columns: dict, rows: int) -> pa.RecordBatch:
    """The columns, and nulls for the others."""
    arrays = [pa.array(columns[f.name], f.type) if f.name in columns and not isinstance(columns[f.name], pa.Array) else columns.get(f.name, pa.nulls(rows, f.type)) for f in ALIGNED_ARROW]
    return pa.RecordBatch.from_arrays(arrays, schema=ALIGNED_ARROW)


def aligner(a: str, b: str, with_groups: bool):
    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            raw, off = utf8(batch["text"])
            for lo, hi in slices(off, CHUNK):
                yield from chunk_rows(pair_of(a, b), number, batch["doc_id"].slice(lo, hi - lo), raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], with_groups)
                number += 1

    return run


def aligned(docs: DataFrame, vocabularies: tuple[str, str] | None = None, with_groups: bool = False) -> DataFrame:
    """Written: the rows of all chunks (see chunk_rows). with_groups: the groups of each document as a string, too."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    a, b = vocabularies or default_vocabularies()
    return materialize(own.mapInArrow(aligner(a, b, with_groups), ALIGNED), "aligned")


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair (id of A times the size of B's vocabulary, plus id of B), n: the documents that hold it linked."""
    return rows.where(F.col("kind") == PAIR).groupBy("pair").agg(F.sum("n").alias("n"))


def scorer(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """Of a chunk's documents, links whose pair is among the best of its A id, and the sum of counts over links."""
    pairs = pairs.sort_by("pair")
    counts, best = pairs["count"].to_numpy(), pairs["best"].to_numpy()
    docs = docs.combine_chunks()
    edge = np.concatenate(([0], np.cumsum(np.array([len(x) for x in docs["held"].to_pylist()], np.int64) // 4)))
    held, times = (np.frombuffer(b"".join(docs[c].to_pylist()), "<u4").astype(np.int64) for c in ("held", "times"))
    sums = [np.diff(np.concatenate(([0], np.cumsum(times * values[held])))[edge]) for values in (best.astype(np.int64), counts)]
    columns = {"n_best": pa.array(sums[0], pa.int64()), "count_sum": pa.array(sums[1], pa.int64())}
    return pa.table([columns.get(f.name, docs[f.name] if f.name in docs.column_names else None) for f in SCORED_ARROW], schema=SCORED_ARROW)


def align(docs: DataFrame, vocabularies: tuple[str, str] | None = None, with_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and groups of every row of docs (doc_id, text).

    The best counts of A ids are broadcast: one number for each id of A's vocabulary at most.
    """
    vocabularies = vocabularies or default_vocabularies()
    rows = aligned(docs, vocabularies, with_groups)
    counts = materialize(pair_counts(rows), "pair-counts")
    of_a = F.floor(F.col("pair") / F.lit(pair_of(*vocabularies).size_b))
    top = counts.groupBy(of_a.alias("a")).agg(F.max("n").alias("top"))
    scored = counts.withColumn("a", of_a).join(F.broadcast(top), "a").select("pair", F.col("n").alias("count"), (F.col("n") == F.col("top")).alias("best"))
    asked = rows.where(F.col("kind") == PAIR).select(F.col("chunk").alias("asking"), "pair").join(scored, "pair")
    own = rows.where(F.col("kind") == DOCUMENT).select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "held", "times")
    return own.groupBy("chunk").cogroup(asked.groupBy("asking")).applyInArrow(scorer, SCORED)


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents")).drop("groups")
