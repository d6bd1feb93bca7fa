"""Page layout: reading direction, lines from words, rules, triage, reading order.

Words have doc, page, word, text, x0, y0, x1, y1 and direction (degrees).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from veritrail.operators.folds import folded


def reading_frame(words: DataFrame) -> DataFrame:
    """(doc, page, direction) with the most characters; ties go to the smaller angle."""
    votes = words.groupBy("doc", "page", "direction").agg(F.sum(F.length("text")).alias("n"))
    return votes.groupBy("doc", "page").agg(F.max_by("direction", F.struct("n", -F.col("direction"))).alias("direction"))


def rotated(x0: Column, y0: Column, x1: Column, y1: Column, direction: Column, width: Column, height: Column) -> Column:
    """A box in the reading frame of the page, as struct(x0, y0, x1, y1)."""
    box = lambda a, b, c, d: F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1"))
    return F.when(direction == 90, box(y0, width - x1, y1, width - x0)).when(direction == 180, box(width - x1, height - y1, width - x0, height - y0)).when(direction == 270, box(height - y1, x0, height - y0, x1)).otherwise(box(x0, y0, x1, y1))


def word_lines(words: DataFrame) -> DataFrame:
    """Words with their line: a word joins the open line if half its height overlaps the line's first word.

    One ordered pass over each page's words.
    """
    y0, y1 = words.columns.index("y0"), words.columns.index("y1")

    def scan(page: list[tuple]) -> list[tuple]:
        line, top, bottom, out = 0, None, None, []
        for w in page:
            a, b = float(w[y0]), float(w[y1])
            if top is None or min(bottom, b) - max(top, a) < 0.5 * min(b - a, bottom - top):
                line, top, bottom = line + 1, a, b
            out.append((*w, line))
        return out

    return folded(words, ["doc", "page"], ["y0", "x0", "y1", "x1", "word"], scan, T.StructType([*words.schema.fields, T.StructField("line", T.IntegerType())]))


def line_texts(lined: DataFrame) -> DataFrame:
    """Lines with text, box and the offsets of their text in the page text (lines end in one break)."""
    own = lined.groupBy("doc", "page", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word", "text"))), lambda s: s["text"]), " ").alias("text"), *(F.min(c).alias(c) for c in ("x0", "y0")), *(F.max(c).alias(c) for c in ("x1", "y1")))
    before = Window.partitionBy("doc", "page").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))
    return own.withColumn("start", start).withColumn("end", F.col("start") + F.length("text"))


def joined_rules(segments: DataFrame, gap: float = 3.0) -> DataFrame:
    """Horizontal segments (doc, page, y, x0, x1) at one height, joined over gaps of at most `gap`."""
    order = Window.partitionBy("doc", "page", "y").orderBy("x0", "x1")
    reach = F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    own = segments.withColumn("_new", F.when(F.col("x0") <= reach + gap, 0).otherwise(1)).withColumn("_g", F.sum("_new").over(order))
    return own.groupBy("doc", "page", "y", "_g").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_g")


def triage(pages: DataFrame, bad: float = 0.05, least: int = 20) -> DataFrame:
    """pages (doc, page, text, images): broken if over `bad` of the characters are unreadable, ocr if hardly any text lies over images."""
    text = F.coalesce("text", F.lit(""))
    wrong = F.length(text) - F.length(F.regexp_replace(text, "[\\uFFFD\\uE000-\\uF8FF\\x00-\\x08\\x0E-\\x1F]", ""))
    kind = F.when((F.length(F.trim(text)) < least) & (F.col("images") > 0), "ocr").when(F.try_divide(wrong, F.length(text)) > bad, "broken").otherwise("text")
    return pages.withColumn("kind", kind)


def reading_order(boxes: DataFrame) -> DataFrame:
    """boxes (doc, page, item, x0, y0, x1, y1) with their place in reading order, by recursive cuts at white bands."""

    def cut(rows: list[tuple]) -> list:
        if len(rows) <= 1:
            return [r[0] for r in rows]
        for lo, hi in ((1, 3), (2, 4)):  # columns first where a gutter runs through, else bands
            parts, reach = [], None
            for r in sorted(rows, key=lambda r: (r[lo], r[hi])):
                if reach is None or r[lo] >= reach:
                    parts.append([])
                parts[-1].append(r)
                reach = max(reach if reach is not None else r[hi], r[hi])
            if len(parts) > 1:
                return [i for p in parts for i in cut(p)]
        return [r[0] for r in sorted(rows, key=lambda r: (r[2], r[1]))]

    def run(page: list[tuple]) -> list[tuple]:
        place = {item: i for i, item in enumerate(cut([r[2:] for r in page]))}
        return [(*r[:3], place[r[2]]) for r in page]

    kinds = dict(boxes.dtypes)
    own = boxes.select("doc", "page", "item", "x0", "y0", "x1", "y1")
    return folded(own, ["doc", "page"], [], run, f"doc {kinds['doc']}, page {kinds['page']}, item {kinds['item']}, place int")
