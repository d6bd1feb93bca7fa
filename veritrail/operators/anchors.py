"""Anchors: quotes bound to layers of a document, their new places on other layers, page checks, uploads.

Anchors have anchor_id, doc, quote, prefix, suffix, start; layers have doc, layer, text.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions import similarity, spans
from veritrail.operators.folds import dealt

CONTEXT = 32
FOUND = "anchor_id string, doc string, layer string, state string, start int, end int, score double"


def place(quote: str, prefix: str, suffix: str, start: int, text: str, least: float = 85.0) -> tuple[str, int | None, int | None, float]:
    """exact: one place, or one place with the same context; ambiguous: several; candidate: a fuzzy place; else unresolved."""
    hits = spans.find_quote(quote, text)
    if len(hits) == 1:
        return "exact", *hits[0], 100.0
    if hits:
        fits = [h for h in hits if text[max(0, h[0] - len(prefix)) : h[0]] == prefix and text[h[1] : h[1] + len(suffix)] == suffix]
        if len(fits) == 1:
            return "exact", *fits[0], 100.0
        near = min(hits, key=lambda h: (abs(h[0] - start), h[0]))
        return "ambiguous", *near, 100.0
    lo = max(0, start - 20 * len(quote))
    window = text[lo : start + 20 * len(quote) + len(quote)]
    score, a, b = similarity.partial(quote, window) if quote and window else (0.0, 0, 0)
    return ("candidate", lo + a, lo + b, score) if score >= least else ("unresolved", None, None, score)


def resolve(anchors: DataFrame, layers: DataFrame) -> DataFrame:
    """Every anchor on every layer of its document."""
    def run(batches):
        for p in batches:
            out = [(r.anchor_id, r.doc, r.layer, *place(r.quote, r.prefix or "", r.suffix or "", int(r.start), r.text or "")) for r in p.itertuples()]
            frame = pd.DataFrame(out, columns=["anchor_id", "doc", "layer", "state", "start", "end", "score"])
            frame[["start", "end"]] = frame[["start", "end"]].astype("Int32")
            yield frame

    both = anchors.join(layers, "doc").select("anchor_id", "doc", "layer", "quote", "prefix", "suffix", "start", "text")
    return dealt(both, "anchor_id", "layer").mapInPandas(run, FOUND)


def make_anchors(wanted: DataFrame, layers: DataFrame) -> DataFrame:
    """Anchors from spans (doc, layer, start, end): the quote and the text around it."""
    own = wanted.join(layers, ["doc", "layer"])
    cut = lambda a, n: F.substr("text", a + 1, n)
    s, e = F.col("start"), F.col("end")
    before = F.greatest(F.lit(0), s - CONTEXT)
    digest = F.sha2(F.concat_ws("\x1f", "doc", "layer", s.cast("string"), e.cast("string")), 256)
    return own.select(digest.alias("anchor_id"), "doc", cut(s, e - s).alias("quote"), cut(before, s - before).alias("prefix"), cut(e, F.lit(CONTEXT)).alias("suffix"), "start")


def touched(wanted: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines that a span overlaps, with the union box of each page (half-open offsets)."""
    l = lines.select("doc", "page", "line", F.col("start").alias("ls"), F.col("end").alias("le"), "x0", "y0", "x1", "y1")
    hit = wanted.join(l, "doc").where((F.col("ls") < F.col("end")) & (F.col("start") < F.col("le")))
    return hit.groupBy("doc", "start", "end", "page").agg(F.array_sort(F.collect_list("line")).alias("lines"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def remapped(anchors: DataFrame, layers: DataFrame, known: DataFrame) -> DataFrame:
    """Places kept from earlier for the anchors and layers that have one, computed for the rest."""
    keys = ["anchor_id", "layer"]
    open_ = anchors.select("anchor_id", "doc").join(layers.select("doc", "layer"), "doc").join(known.select(*keys), keys, "left_anti")
    fresh = resolve(anchors, layers).join(open_.select(*keys), keys, "left_semi")
    return known.unionByName(fresh)


def _title_fit(title: Column, page: Column, least: int = 95) -> Column:
    """The likeness of a title and the stretch of a page most like it, if it may be `least`; else null.

    Such a stretch misses at most `lost` characters of the title and has as many others, so of 2 * lost + 1 parts of the
    title one stands unchanged on the page: only pages with such a part are scored. A page shorter than the title can't show it.
    """
    n = F.length(title)
    parts = 2 * F.floor(n * (100 - least) / 100 + 1e-9).cast("int") + 1
    cut = lambda i: F.floor(i * n / parts + 1e-9).cast("int")
    part = F.exists(F.sequence(F.lit(0), parts - 1), lambda i: F.contains(page, F.substr(title, cut(i) + 1, cut(i + 1) - cut(i))))
    whole = F.contains(page, title)
    near = (title != "") & (F.length(page) >= n) & ~whole & part
    scored = similarity.partial_ratio(F.when(near, title), F.when(near, page))
    return F.when((title != "") & whole, 100.0).otherwise(scored)


def check_pages(pages: DataFrame, reports: DataFrame) -> DataFrame:
    """Whether the first three pages show the report's DOI (whole, over line ends) or one of the first two, each whole, its title: match, mismatch or unchecked."""
    head = pages.where("page <= 3").groupBy("doc").agg(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text"))).alias("head"))
    own = dealt(reports.join(head, "doc", "left"), "doc")
    texts = lambda *n: F.transform(F.filter(F.coalesce("head", F.array().cast("array<struct<page int, text string>>")), lambda p: p["page"].isin(*n)), lambda p: p["text"])
    doi = F.lower("doi")

    def shows(page):
        joined = F.regexp_replace(F.lower(page), r"\s*\n\s*", "")
        return F.contains(joined, doi) & ~F.substr(joined, F.instr(joined, doi) + F.length("doi"), F.lit(1)).rlike("[0-9a-z]")

    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"(?U)[^\w]+", " "))
    once_a_row = lambda c: F.explode(F.array(c))  # noqa: E731  what stands in many expressions below is worked out once
    own = own.withColumn("_t", once_a_row(F.struct(plain(F.coalesce("title", F.lit(""))).alias("title"), *(plain(F.array_join(texts(n), "\n")).alias(f"p{n}") for n in (1, 2)))))
    title, page = F.col("_t.title"), [F.col("_t.p1"), F.col("_t.p2")]
    like = F.greatest(*(_title_fit(title, p) for p in page))
    read = F.length(F.trim(F.array_join(texts(1, 2, 3), "\n"))) >= 20
    state = F.when(~read, "unchecked").when(F.coalesce(F.exists(texts(1, 2, 3), shows), F.lit(False)), "match").when(like >= 95, "match").otherwise("mismatch")
    return own.select("doc", state.alias("state"))


def planned_uploads(files: DataFrame, reports: DataFrame) -> DataFrame:
    """File names to reports by a DOI (slashes as _ or -) or PMID that stands alone in the name; several reports: held."""
    key = F.regexp_replace(F.lower("doi"), r"[^a-z0-9]+", "_")
    ids = reports.select("report_id", F.explode(F.array_compact(F.array(F.concat(F.lit("d:"), key), F.concat(F.lit("p:"), "pmid")))).alias("id"))
    name = F.regexp_replace(F.lower(F.regexp_replace("file", r"\.[a-zA-Z]+$", "")), r"[^a-z0-9]+", "_")
    doi = F.regexp_extract(name, r"(10_\d{4,9}_.+)$", 1)
    numbers = F.transform(F.regexp_extract_all(name, F.lit(r"(?<![0-9])(\d{5,9})(?![0-9])"), F.lit(1)), lambda n: F.concat(F.lit("p:"), n))
    own = files.select("file", F.explode(F.concat(F.array(F.concat(F.lit("d:"), doi)), numbers)).alias("id"))
    hits = own.join(ids, "id").groupBy("file").agg(F.collect_set("report_id").alias("r"))
    return files.select("file").join(hits, "file", "left").select("file", F.when(F.size("r") == 1, F.get("r", F.lit(0))).alias("report_id"), F.when(F.col("r").isNull(), "unknown").when(F.size("r") > 1, "held").otherwise("planned").alias("state"))


def grounded(answers: DataFrame, layers: DataFrame) -> DataFrame:
    """Answered values (doc, field, value, quote): extracted if the quote stands in the text once and prints the value."""
    from veritrail.functions import numbers

    own = answers.join(layers.select("doc", "text"), "doc", "left")
    own = own.withColumn("places", spans.token_places(F.col("quote"), F.col("text")))
    printed = F.contains(F.lower("quote"), F.lower("value")) | F.coalesce(numbers.printed_in(F.col("value"), F.col("quote")), F.lit(False))
    status = F.when(F.col("value").isNull(), "missing").when(F.size("places") == 0, "invalid").when(~printed, "invalid").when(F.size("places") > 1, "ambiguous").otherwise("extracted")
    return own.select("doc", "field", "value", status.alias("status"), "places")


def ranked_mentions(mentions: DataFrame, gap: int = 60) -> DataFrame:
    """Mentions (doc, start, end, section, study_label, specific): best of each passage, by section weight, label and words."""
    from veritrail.operators.ranking import islands

    weights = {"methods": 0, "abstract": 1, "results": 2, "introduction": 3, "discussion": 4, "references": 5}
    weight = F.coalesce(*[F.when(F.lower("section") == s, w) for s, w in weights.items()], F.lit(3))
    cost = 8 * weight + F.when(F.col("study_label"), 3).otherwise(0) + 3 - F.least(F.col("specific"), F.lit(3))
    own = islands(mentions.withColumn("cost", cost), ["doc"], "start", "end", gap)
    best = own.groupBy("doc", "passage").agg(F.min_by(F.struct("start", "end", "cost"), F.struct("cost", "start")).alias("m"))
    return best.select("doc", "passage", "m.*")


WORD = re.compile(r"\w+", re.U)


def page_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc, page, similarity): word-sequence likeness of two layers of a page."""
    both = a.select("doc", "page", F.col("text").alias("x")).join(b.select("doc", "page", F.col("text").alias("y")), ["doc", "page"], "full_outer")

    def run(batches):
        for p in batches:
            codes: dict[str, str] = {}
            code = lambda t: "".join(codes.setdefault(w, chr(0x100 + len(codes))) for w in WORD.findall(t or ""))  # noqa: B023, E731
            p["similarity"] = [similarity.ratio(code(x), code(y)) / 100 for x, y in zip(p["x"], p["y"])]
            yield p[["doc", "page", "similarity"]]

    kinds = dict(both.dtypes)
    return both.mapInPandas(run, f"doc {kinds['doc']}, page {kinds['page']}, similarity double")
