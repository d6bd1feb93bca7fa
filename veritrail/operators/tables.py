"""Tables on pages: borderless ones from word places, form lines, carried headers, torn cells, grids.

Words have doc, page, text, x0, y0, x1, y1 and line (see layout.word_lines); cells have doc, page, table, row, col, text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrail.operators.folds import folded

CELLS = "doc string, page int, table int, row int, col int, text string"
NUMBER = re.compile(r"^[<>≤≥(\[]*[-+−]?\d[\d.,%()\[\]/–-]*$")


class Word(NamedTuple):
    doc: str
    page: int
    table: int
    line: int
    text: str
    x0: float
    x1: float


def _lines(words: list[Word]) -> list[list[Word]]:
    """The words of each line, from words sorted by line and place."""
    return [list(own) for line, own in groupby(words, key=lambda w: w.line) if line is not None]


def numeric_bands(words: list, support: int) -> list[tuple[float, float]]:
    """Column bands: x ranges in which at least `support` numbers lie, joined where they overlap."""
    bands: list[list] = []
    for w in sorted((w for w in words if NUMBER.match(w.text)), key=lambda w: (w.x0, w.x1)):
        if bands and w.x0 <= bands[-1][1]:
            bands[-1][1] = max(bands[-1][1], w.x1)
            bands[-1][2] += 1
        else:
            bands.append([w.x0, w.x1, 1])
    return [(a, b) for a, b, n in bands if n >= support]


def word_tables(words: DataFrame, support: int = 3, coverage: float = 0.6) -> DataFrame:
    """The borderless table of each page: rows that fill at least `coverage` of the numeric columns, and the header above them.

    Everything left of the first column is the label. A page is small, so each is folded by itself.
    """

    def run(page: list[tuple]) -> Iterator[tuple]:
        own = [Word(*w) for w in page]
        bands = numeric_bands(own, support)

        def read(line: list[Word]) -> tuple[list[str], bool]:
            cells = [[] for _ in range(len(bands) + 1)]
            for w in line:
                middle = (w.x0 + w.x1) / 2
                at = next((i + 1 for i, (a, b) in enumerate(bands) if a <= middle <= b), 0 if not bands or middle < bands[0][0] else None)
                if at is not None:
                    cells[at].append(w.text)
            filled = sum(any(NUMBER.match(t) for t in c) for c in cells[1:])
            return [" ".join(c) for c in cells], bool(bands) and filled >= coverage * len(bands)

        rows = [read(line) for line in _lines(own)]
        data = [i for i, (_, d) in enumerate(rows) if d]
        if len(data) >= support:
            for i, (cells, _) in enumerate(rows[max(0, data[0] - 1) : data[-1] + 1]):
                for j, t in enumerate(cells):
                    yield str(own[0].doc), int(own[0].page), 1, i, j, t

    own = words.withColumn("table", F.lit(1)).select(*Word._fields)
    return folded(own, ["doc", "page"], ["line", "x0"], run, CELLS)


def form_tables(lines: DataFrame, least: int = 3) -> DataFrame:
    """Label and value spans on shared baselines, label edges aligned over at least `least` lines, as two-column tables."""
    l = lines.select("doc", "page", F.col("line").alias("row"), "text", "x0", "x1", "y1", F.round(F.col("y1") / 4).alias("band"))
    left = l.select("doc", "page", "band", "row", F.col("text").alias("label"), "x0", "x1")
    right = l.select("doc", "page", "band", F.col("row").alias("value_row"), F.col("text").alias("value"), F.col("x0").alias("vx"))
    pairs = left.join(right, ["doc", "page", "band"]).where("vx > x1").groupBy("doc", "page", "row", "label", "x0").agg(F.min_by("value", "vx").alias("value"))
    edge = F.round(F.col("x0") / 3)
    sized = pairs.withColumn("edge", edge).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc", "page", "edge"))).where(F.col("n") >= least)
    place = F.row_number().over(Window.partitionBy("doc", "page").orderBy("row")) - 1
    own = sized.withColumn("r", place)
    return own.select("doc", "page", F.lit(1).alias("table"), F.col("r").alias("row"), F.posexplode(F.array("label", "value")).alias("col", "text"))


def carried_headers(tables: DataFrame) -> DataFrame:
    """tables (doc, page, table, columns, header array, first, last): a table that opens a page without a header, as wide as the one that closed the page before, takes its header."""
    order = Window.partitionBy("doc").orderBy("page", "table")
    before = F.lag(F.struct("page", "columns", "header", "last")).over(order)
    own = tables.withColumn("_b", before)
    fits = (F.col("_b.page") == F.col("page") - 1) & F.col("_b.last") & F.col("first") & F.col("header").isNull() & (F.col("_b.columns") == F.col("columns"))
    return own.withColumn("carried", F.coalesce(fits, F.lit(False))).withColumn("header", F.when(F.col("carried"), F.col("_b.header")).otherwise(F.col("header"))).drop("_b")


def torn_tables(cells: DataFrame, words: DataFrame, label_least: float = 0.9, value_least: float = 0.75) -> DataFrame:
    """(doc, page, table, label_whole, value_whole, torn): share of cells all of whose tokens are words of the page."""
    known = words.groupBy("doc", "page").agg(F.collect_set("text").alias("known"))
    own = cells.where("trim(text) <> ''").join(known, ["doc", "page"], "left")
    whole = F.forall(F.split(F.trim("text"), r"\s+"), lambda t: F.array_contains("known", t)).cast("int")
    share = own.groupBy("doc", "page", "table").agg(F.avg(F.when(F.col("col") == 0, whole)).alias("label_whole"), F.avg(F.when(F.col("col") > 0, whole)).alias("value_whole"))
    return share.withColumn("torn", (F.coalesce("label_whole", F.lit(1.0)) < label_least) | (F.coalesce("value_whole", F.lit(1.0)) < value_least))


def word_grids(words: DataFrame, gap_share: float = 0.1, least_gap: float = 6.0) -> DataFrame:
    """Cells from the words of a table region: columns part at white gaps that at most `gap_share` of the rows cross."""

    def run(region: list[tuple]) -> Iterator[tuple]:
        lines = _lines([Word(*w) for w in region])
        edges = sorted({w.x0 for l in lines for w in l} | {w.x1 for l in lines for w in l})
        cuts, open_ = [], None
        for a, b in zip(edges, edges[1:]):
            crossed = sum(any(w.x0 < b and w.x1 > a for w in l) for l in lines)
            if crossed <= gap_share * len(lines):
                open_ = (open_[0], b) if open_ else (a, b)
            elif open_:
                cuts.append(open_)
                open_ = None
        marks = [(a + b) / 2 for a, b in cuts if b - a >= least_gap]
        doc, page, table = region[0][:3]
        for i, l in enumerate(lines):
            row = [[] for _ in range(len(marks) + 1)]
            for w in l:
                row[sum((w.x0 + w.x1) / 2 > m for m in marks)].append(w.text)
            for j, t in enumerate(row):
                yield str(doc), int(page), int(table), i, j, " ".join(t)

    return folded(words.select(*Word._fields), ["doc", "page", "table"], ["line", "x0"], run, CELLS)


def header_paths(cells: DataFrame, header_rows: int) -> DataFrame:
    """Body cells with the texts of the header rows above them, joined; an empty header cell takes the one to its left."""
    fill = Window.partitionBy("doc", "page", "table", "row").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    head = cells.where(F.col("row") < header_rows).withColumn("t", F.last(F.when(F.trim("text") != "", F.trim("text")), ignorenulls=True).over(fill))
    path = head.groupBy("doc", "page", "table", "col").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("row", "t"))), lambda s: s["t"])), " / ").alias("header"))
    return cells.where(F.col("row") >= header_rows).join(path, ["doc", "page", "table", "col"], "left")
