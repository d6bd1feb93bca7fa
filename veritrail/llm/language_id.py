"""Language ID: unigram pieces per language, marginalised over all segmentations.

The pieces are those of a fixed public vocabulary. For each language, expectation
maximisation over words fits piece probabilities: the forward and backward sums over every
segmentation of a word give the expected uses of each piece. A text's score in a language is
the sum of its words' log forward sums, and the language with the best posterior is predicted.
A piece never crosses white space, so words are scored once and kept. Words of LONG characters
and more are summed with rescaling; the fit takes them in parts.

Bounds, as parameters: the fit takes about `sample` labelled rows of each language, chosen by
hash, with texts of at most `longest` bytes. Prediction reads whole texts.

Defined cases: a null text or one without a letter (str.isalpha: no digits, fractions or circled signs) is `und` with score 0, as is everything if
nothing was learned; a character in no piece has a probability of its own; equal scores go to
the first language in order; repeated rows and a null doc_id (not held out, not learned from)
are scored like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import table

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
MARK = "▁"
#: A forward sum gains about this factor a character, so that words under LONG characters don't underflow:
#: unknown pieces of a probability down to 1e-9 leave (GAIN * 1e-9) ** LONG > 1e-250.
GAIN = 24.0
LONG = 32


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str) -> list[str]:
    """The text pieces of a sentencepiece vocabulary (no control, unknown or byte pieces)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class Lattice:
    """Finds the pieces in words."""

    def __init__(self, pieces: list[str]):
        self.ids = {p: i for i, p in enumerate(pieces)}
        self.stems = {p[:n] for p in pieces for n in range(1, len(p) + 1)}
        self.unknown = len(pieces)

    def edges(self, word: str, out: list[int]) -> None:
        """Append every piece in the word as piece << 32 | start << 16 | end; a character in none is an unknown piece."""
        get, stems, n, unknown = self.ids.get, self.stems, len(word), self.unknown
        for s in range(n):
            e = s + 1
            part = word[s:e]
            out.append(get(part, unknown) << 32 | s << 16 | e)
            while part in stems and e < n:
                e += 1
                part = word[s:e]
                if (i := get(part)) is not None:
                    out.append(i << 32 | s << 16 | e)


class Batch:
    """The lattices of some words (of at most LONG characters), as arrays of edges."""

    def __init__(self, words: list[str], lattice: Lattice):
        flat: list[int] = []
        cut = [0]
        for w in words:
            lattice.edges(w, flat)
            cut.append(len(flat))
        code = np.array(flat, np.int64)
        self.word = np.repeat(np.arange(len(words)), np.diff(cut))
        self.piece, self.start, self.end = code >> 32, (code >> 16) & 0xFFFF, code & 0xFFFF
        self.length = np.array([len(w) for w in words], np.int64)

    def _steps(self, key: np.ndarray, descending: bool):
        """Edges with the same key, by falling or rising key: (key, edges, first edge of each word, those words)."""
        by = np.argsort((LONG + 8 - key if descending else key).astype(np.uint8), kind="stable")
        k, w = key[by], self.word[by]
        if not len(k):
            return
        cut = np.concatenate((np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))), [len(k)]))
        for lo, hi in zip(cut[:-1], cut[1:]):
            head = np.flatnonzero(np.concatenate(([True], w[lo + 1 : hi] != w[lo : hi - 1])))
            yield int(k[lo]), by[lo:hi], head, w[lo:hi][head]

    def forward(self, p: np.ndarray) -> np.ndarray:
        """Sums over the segmentations of each word's first i characters: (words, length + 1, languages)."""
        out = np.zeros((len(self.length), int(self.length.max(initial=0)) + 1, p.shape[1]))
        out[:, 0] = 1
        weight = p[self.piece] * (GAIN ** (self.end - self.start))[:, None]
        for at, own, head, words in self._steps(self.end, False):
            out[words, at] = np.add.reduceat(out[self.word[own], self.start[own]] * weight[own], head, axis=0)
        return out

    def backward(self, p: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.length), int(self.length.max(initial=0)) + 1, p.shape[1]))
        out[np.arange(len(self.length)), self.length] = 1
        weight = p[self.piece] * (GAIN ** (self.end - self.start))[:, None]
        for at, own, head, words in self._steps(self.start, True):
            out[words, at] = np.add.reduceat(out[self.word[own], self.end[own]] * weight[own], head, axis=0)
        return out

    def log_sums(self, p: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language."""
        total = self.forward(p)[np.arange(len(self.length)), self.length]
        return np.log(np.maximum(total, 1e-290)) - (self.length * np.log(GAIN))[:, None]


def long_log_sums(word: str, lattice: Lattice, p: np.ndarray) -> np.ndarray:
    """The same for one long word, rescaled at every character."""
    size = max(map(len, lattice.ids), default=1)
    ends: dict[int, list[tuple[int, int]]] = {}
    sums = np.zeros((len(word) + 1, p.shape[1]))
    logs = np.zeros(p.shape[1])
    sums[0] = 1
    for lo in range(0, len(word), 1024):  # pieces that start here
        found: list[int] = []
        lattice.edges(word[lo : lo + 1024 + size], found)
        for code in found:
            s, e = (code >> 16) & 0xFFFF, code & 0xFFFF
            if s < 1024:
                ends.setdefault(lo + e, []).append((lo + s, code >> 32))
        for at in range(lo + 1, min(lo + 1024, len(word)) + 1):
            value = np.zeros(p.shape[1])
            for s, i in ends.pop(at, ()):
                value += sums[s] * p[i]
            scale = np.maximum(value, 1e-290)
            sums[max(0, at - size) : at] /= scale
            sums[at] = value / scale
            logs += np.log(scale)
    return logs


def stretches(word: str) -> list[str]:
    """A long word in parts of under LONG characters, for the fit: in scripts without spaces, whole lines are one word."""
    return [word[lo : lo + LONG - 1] for lo in range(0, len(word), LONG - 1)]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def fit(rows: list[tuple[str, str]], pieces: list[str], rounds: int = 4, floor: float = 0.02) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log priors, piece probabilities: pieces + 1 by languages) from (language, text) rows."""
    lattice = Lattice(pieces)
    languages = sorted({lang for lang, _ in rows})
    number = {lang: k for k, lang in enumerate(languages)}
    counts: dict[str, np.ndarray] = {}  # by word with its mark, or stretch of a long word
    docs = np.zeros(len(languages))
    for lang, text in rows:
        k = number[lang]
        docs[k] += 1
        for w in text.lower().split():
            for part in [MARK + w] if len(w) < LONG else stretches(MARK + w):
                counts.setdefault(part, np.zeros(len(languages), np.int32))[k] += 1
    words = sorted(counts)
    p = np.full((len(pieces) + 1, len(languages)), 1 / (len(pieces) + 1))
    for _ in range(rounds if words else 0):
        used = np.zeros_like(p)
        for lo in range(0, len(words), 20_000):
            own = words[lo : lo + 20_000]
            batch = Batch(own, lattice)
            ahead, behind = batch.forward(p), batch.backward(p)
            share = np.array([counts[w] for w in own]) / np.maximum(behind[:, 0], 1e-290)
            weight = p[batch.piece] * (GAIN ** (batch.end - batch.start))[:, None]
            each = ahead[batch.word, batch.start] * weight * behind[batch.word, batch.end] * share[batch.word]
            for k in range(p.shape[1]):
                used[:, k] += np.bincount(batch.piece, each[:, k], minlength=len(p))
        p = (used + floor) / (used.sum(0) + floor * len(p))
    return languages, np.log((docs + 0.5) / (docs.sum() + 0.5 * max(1, len(languages)))), p


class Scorer:
    """Scores texts; the sums of words seen are kept, up to a bound."""

    def __init__(self, languages: list[str], prior: np.ndarray, p: np.ndarray, pieces: list[str], keep: int = 3_200_000):
        self.languages, self.prior, self.p = languages, prior, p
        self.lattice = Lattice(pieces)
        self.most = max(1000, keep // max(1, len(languages)))
        self.rows: dict[str, int] = {}
        self.sums = np.zeros((0, len(languages)))

    def learn(self, words: list[str]) -> None:
        parts = []
        short = [w for w in words if len(w) < LONG]
        for lo in range(0, len(short), 20_000):
            own = short[lo : lo + 20_000]
            parts.append(Batch([MARK + w for w in own], self.lattice).log_sums(self.p))
            self.rows.update(zip(own, range(len(self.rows), len(self.rows) + len(own))))
        for w in words:
            if len(w) >= LONG:
                parts.append(long_log_sums(MARK + w, self.lattice, self.p)[None])
                self.rows[w] = len(self.rows)
        self.sums = np.concatenate([self.sums, *parts])

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.languages:
            return [("und", 0.0)] * len(texts)
        if len(self.rows) > self.most:
            self.rows, self.sums = {}, np.zeros((0, len(self.languages)))
        split = [t.lower().split() if has_letter(t) else [] for t in texts]
        new = {w for words in split for w in words} - self.rows.keys()
        self.learn(sorted(new))
        at = np.fromiter((self.rows[w] for words in split for w in words), np.int64)
        cut = np.concatenate(([0], np.cumsum([len(w) for w in split])))
        sums = np.zeros((len(texts), len(self.languages)))
        some = np.flatnonzero(np.diff(cut))
        if len(some):
            sums[some] = np.add.reduceat(self.sums[at], cut[some], axis=0)
        sums += self.prior
        best = sums.argmax(1)
        share = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
        return [(self.languages[b], float(s)) if words else ("und", 0.0) for words, b, s in zip(split, best, share)]


_SCORER: dict[str, Scorer] = {}


def scorer_of(name: str, model: tuple) -> Scorer:
    """The scorer of a model, kept for the next task of the same worker."""
    if name not in _SCORER:
        _SCORER.clear()
        _SCORER[name] = Scorer(*model)
    return _SCORER[name]


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def language_id(docs: DataFrame, sample: int = 400, longest: int = 1 << 16, vocabulary: str | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row. docs needs doc_id, text, lang."""
    pieces = load_pieces(vocabulary or default_vocabulary())
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & (F.octet_length("text") <= longest))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    rows = []
    if sizes:
        share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, sample / n))) for lang, n in sizes.items()])
        chosen = known.where(F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.lit(1_000_000)) < share * 1_000_000)
        rows = [(r["lang"], r["text"]) for r in chosen.select("lang", "text").collect()]  # about `sample` rows a language
    languages, prior, p = fit(rows, pieces)
    model = docs.sparkSession.sparkContext.broadcast((languages, prior, p, pieces))
    name = uuid.uuid4().hex

    def run(batches):
        scorer = scorer_of(name, model.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                found = scorer.score(part["text"].to_pylist())
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], schema=ARROW)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, SCHEMA)


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))
