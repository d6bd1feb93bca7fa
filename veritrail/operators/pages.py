"""The page model: tiles of a detected table, and one canonical text in which every word, line, cell, table and page has its place.

Offsets are half-open, in characters of the document's text. Words are joined by a space; lines of a block by a line
break; cells of a table row by a tab, its rows by a line break; blocks and tables by an empty line; pages by a form
feed between line breaks. Blocks without words leave nothing; tables and pages always stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrail.functions import text

#: Ligatures and the letters they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
PAGE_BREAK, BLOCK_BREAK = "\n\f\n", "\n\n"


def plain_word(word: Column, composed: bool = False) -> Column:
    """A word as the canonical text has it: composed, ligatures apart, invisible characters dropped, a soft hyphen at its end printed.

    composed: it is NFC already.
    """
    own = F.coalesce(word, F.lit(""))
    whole = F.trim(own if composed else text.nfc(own))
    for joined, apart in LIGATURES.items():
        whole = F.replace(whole, F.lit(joined), F.lit(apart))
    seen = F.regexp_replace(whole, r"[\p{Cc}\p{Cf}]", "")
    return F.when(whole.endswith("­") & (seen != ""), F.concat(seen, F.lit("-"))).otherwise(seen)


# tiles


def boundaries(slots: DataFrame, by: list[str]) -> DataFrame:
    """by and bounds: an array of size + 1 rising places that part the slots of an axis.

    slots has by, slot (from 0), lo and hi (extent of what stands in the slot alone; null if nothing does), and size,
    first and last (places where the axis begins and ends). A boundary lies midway between the extents of its neighbours; where
    slots between them are empty, the space is shared evenly.
    """
    order = Window.partitionBy(*by).orderBy("slot")
    known = F.col("lo").isNotNull()
    left = F.last(F.when(known, F.struct("slot", "hi")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    right = F.first(F.when(known, F.struct("slot", "lo")), ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    own = slots.withColumns({"_l": left, "_r": right})
    i, a, b = F.col("slot"), F.col("_l.hi"), F.col("_r.lo")
    apart = F.col("_r.slot") - F.col("_l.slot")
    share = F.when(apart > 1, (i - F.col("_l.slot")) / (apart + 1)).otherwise(F.lit(0.5))
    between = F.when(b > a, a + (b - a) * share).otherwise((a + b) / 2)
    after = a + (F.col("last") - a) * (i - F.col("_l.slot")) / (F.col("size") - F.col("_l.slot"))
    before = F.col("first") + (b - F.col("first")) * i / F.greatest(F.col("_r.slot"), F.lit(1))
    even = F.col("first") + (F.col("last") - F.col("first")) * i / F.col("size")
    place = F.when(i == 0, F.col("first")).when(a.isNotNull() & b.isNotNull(), between).when(a.isNotNull(), after).when(b.isNotNull(), before).otherwise(even)
    rising = own.withColumn("_p", place).withColumn("_p", F.max("_p").over(order))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("slot", "_p"))), lambda s: s["_p"])
    return rising.groupBy(*by).agg(listed.alias("_b"), F.max("last").alias("_end")).select(*by, F.concat("_b", F.array(F.greatest(F.array_max("_b"), F.col("_end")))).alias("bounds"))


def tiles(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells that tile each table without gaps, from a detector's cells, which have text boxes and miss empty places.

    tables: doc, page, table, rows, cols, x0, y0, x1, y1. cells: doc, page, table, row, col, row_span, col_span, header, x0, y0, x1, y1.
    Of cells that begin where an earlier one (by row, then column) already reaches, the earlier one stays; spans
    end at the table's edge. Returns doc, page, table, row, col, row_span, col_span, header, detected, x0, y0, x1, y1.
    """
    key = ["doc", "page", "table"]

    def axis(slot: str, span: str, size: str, lo: str, hi: str) -> DataFrame:
        alone = cells.where((F.col(span) == 1) & (F.col("x1") > F.col("x0"))).groupBy(*key, F.col(slot).alias("slot")).agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"))
        slots = tables.where(F.col(size) > 0).select(*key, F.explode(F.sequence(F.lit(0), F.col(size) - 1)).alias("slot"), F.col(size).alias("size"), F.col(lo).alias("first"), F.col(hi).alias("last"))
        return boundaries(slots.join(alone, [*key, "slot"], "left"), key)

    columns = axis("col", "col_span", "cols", "x0", "x1").withColumnRenamed("bounds", "_x")
    rows = axis("row", "row_span", "rows", "y0", "y1").withColumnRenamed("bounds", "_y")
    size = tables.select(*key, "rows", "cols")
    span = lambda s, at, n: F.greatest(F.lit(1), F.least(F.col(s), F.col(n) - F.col(at))).alias(s)
    fitted = cells.join(size, key).where("row >= 0 and row < rows and col >= 0 and col < cols").select(*key, "row", "col", span("row_span", "row", "rows"), span("col_span", "col", "cols"), F.coalesce("header", F.lit(False)).alias("header"))
    listed = fitted.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("row", "col", "row_span", "col_span", "header"))).alias("_c"))
    covers = lambda k, c: (k["row"] <= c["row"]) & (c["row"] < k["row"] + k["row_span"]) & (k["col"] <= c["col"]) & (c["col"] < k["col"] + k["col_span"])
    kept = F.aggregate("_c", F.slice("_c", F.lit(1), F.lit(0)), lambda held, c: F.when(F.exists(held, lambda k: covers(k, c)), held).otherwise(F.concat(held, F.array(c))))
    own = size.where("rows > 0 and cols > 0").join(listed, key, "left").withColumn("_k", F.coalesce(kept, F.array().cast("array<struct<row:int,col:int,row_span:int,col_span:int,header:boolean>>")))
    place = lambda r, c: F.struct(r.cast("int").alias("row"), c.cast("int").alias("col"))
    every = F.flatten(F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda r: F.transform(F.sequence(F.lit(0), F.col("cols") - 1), lambda c: place(r, c))))
    taken = F.flatten(F.transform("_k", lambda k: F.flatten(F.transform(F.sequence(k["row"], k["row"] + k["row_span"] - 1), lambda r: F.transform(F.sequence(k["col"], k["col"] + k["col_span"] - 1), lambda c: place(r, c))))))
    one = lambda c, detected: F.struct(*(x.cast("int").alias(n) for n, x in zip(("row", "col", "row_span", "col_span"), c[:4])), c[4].alias("header"), F.lit(detected).alias("detected"))
    found = F.transform("_k", lambda k: one([k["row"], k["col"], k["row_span"], k["col_span"], k["header"]], True))
    empty = F.transform(F.array_except(every, taken), lambda p: one([p["row"], p["col"], F.lit(1), F.lit(1), F.lit(False)], False))
    out = own.select(*key, F.explode(F.concat(found, empty)).alias("_t")).select(*key, "_t.*").join(columns, key).join(rows, key)
    at = lambda b, i: F.get(F.col(b), i)
    return out.withColumns({"x0": at("_x", F.col("col")), "y0": at("_y", F.col("row")), "x1": at("_x", F.col("col") + F.col("col_span")), "y1": at("_y", F.col("row") + F.col("row_span"))}).drop("_x", "_y")


# the canonical text

#: What stands in a document's stream: the start of a page, of a cell, of what follows a table's last row, and words. What starts stands before its words.
_PAGE, _CELL, _END, _WORD = 0, 1, 2, 3


def stream(words: DataFrame, cells: DataFrame, pages: DataFrame, composed: bool = False) -> DataFrame:
    """Every word, and the starts of pages and cells, with what separates it from what stands before (sep), its text, and its offsets.

    words: doc, page, item (its place on the page), row, col (of the cell; null in blocks), line, word, text. cells: doc, page,
    item, row, col, rows (of the table). pages: doc, page. Prefix sums run over a document. Tables that are dealt by doc
    aren't shuffled again if words are NFC already (composed), for a function in Python hides how its rows are dealt.
    """
    plain = words.withColumn("text", plain_word(F.col("text"), composed)).where("text <> ''")
    none = F.lit(None).cast("int")
    integer = lambda *names: [F.col(n).cast("int").alias(n) for n in names]
    inside = plain.select("doc", "page", *integer("item", "row", "col", "line", "word"), F.lit(_WORD).alias("kind"), none.alias("rows"), "text")
    starts = cells.select("doc", "page", *integer("item", "row", "col"), none.alias("line"), none.alias("word"), F.lit(_CELL).alias("kind"), *integer("rows"), F.lit("").alias("text"))
    ends = cells.groupBy("doc", "page", "item").agg(F.max("row").alias("last"), F.max("rows").alias("rows")).where("rows > last + 1")
    ends = ends.select("doc", "page", *integer("item"), F.col("rows").cast("int").alias("row"), none.alias("col"), none.alias("line"), none.alias("word"), F.lit(_END).alias("kind"), *integer("rows"), F.repeat(F.lit("\n"), (F.col("rows") - 1 - F.col("last")).cast("int")).alias("text"))
    fronts = pages.select("doc", "page", F.lit(-1).alias("item"), none.alias("row"), none.alias("col"), none.alias("line"), none.alias("word"), F.lit(_PAGE).alias("kind"), none.alias("rows"), F.lit("").alias("text"))
    order = _order()
    before = lambda c: F.when(F.lag("page").over(order) == F.col("page"), F.lag(c).over(order))
    own = fronts.unionByName(starts).unionByName(ends).unionByName(inside)
    own = own.withColumns({"_item": before("item"), "_row": before("row"), "_kind": before("kind"), "_line": before("line"), "_break": _breaks(order)})
    first = F.when(F.col("_item") >= 0, BLOCK_BREAK).otherwise("")  # of an item, unless it opens the page
    cell = F.when(F.col("_item") != F.col("item"), F.concat(first, F.repeat(F.lit("\n"), F.col("row")))).when(F.col("_row") != F.col("row"), F.repeat(F.lit("\n"), F.col("row") - F.col("_row"))).otherwise("\t")
    word = F.when(F.col("_item") != F.col("item"), first).when(F.col("_kind") == _CELL, "").when(F.col("_line") == F.col("line"), " ").otherwise(F.when(F.col("col").isNull(), "\n").otherwise(" "))
    own = own.withColumn("sep", F.when(F.col("kind") == _CELL, cell).when(F.col("kind") == _WORD, word).otherwise("")).drop("_item", "_row", "_kind", "_line")
    end = F.sum(F.length("_break") + F.length("sep") + F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn("end", end).withColumn("start", F.col("end") - F.length("text")).drop("_break")


def _order():
    """Of a document's stream: pages, their items, in an item cells by row and column, each before its words; in a block no rows.

    By columns alone, so that all windows of a stream share one sort.
    """
    return Window.partitionBy("doc").orderBy("page", "item", "row", "col", "kind", "line", "word")


def _breaks(order) -> Column:
    """What stands before a row because its page begins."""
    return F.when(F.lag("page").over(order) != F.col("page"), PAGE_BREAK).otherwise("")


def places(streamed: DataFrame) -> DataFrame:
    """(doc, page, kind, item, row, col, line, word, start, end) of all words, lines, cells, tables and pages of a stream."""
    names = ["item", "row", "col", "line", "word"]

    def of(kind: str, rows: DataFrame, *by: str) -> DataFrame:
        grouped = rows.groupBy("doc", "page", *by).agg(F.min("start").alias("start"), F.max("end").alias("end"))
        return grouped.select("doc", "page", F.lit(kind).alias("kind"), *((F.col(n) if n in by else F.lit(None).cast("int").alias(n)) for n in names), "start", "end")

    tabled = streamed.where((F.col("kind") != _PAGE) & F.col("row").isNotNull())
    words = streamed.where(F.col("kind") == _WORD)
    return (
        of("word", words, *names)
        .unionByName(of("line", words, "item", "row", "col", "line"))
        .unionByName(of("cell", tabled.where(F.col("kind") != _END), "item", "row", "col"))
        .unionByName(of("table", tabled, "item"))
        .unionByName(of("page", streamed))
    )


def whole_texts(streamed: DataFrame) -> DataFrame:
    """(doc, whole, word, line, cell): a document's text and the (starts, ends) of its words, lines and cells, as places has them, read once."""
    order = _order()
    line = F.when(F.col("kind") == _WORD, F.struct("page", "item", "row", "col", "line"))
    cell = F.when(F.col("kind").isin(_CELL, _WORD) & F.col("row").isNotNull(), F.struct("page", "item", "row", "col"))
    edges = {f"{n}_{e}": k.isNotNull() & ~step(k).over(order).eqNullSafe(k) for n, k in (("line", line), ("cell", cell)) for e, step in (("first", F.lag), ("last", F.lead))}
    own = streamed.withColumns({"_n": F.row_number().over(order), "_said": F.concat(_breaks(order), "sep", "text"), "word_first": F.col("kind") == _WORD, **edges})
    own = own.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("_n", "_said", "start", "end", "word_first", *edges))).alias("_p"))
    at = lambda flag, place: F.transform(F.filter("_p", lambda p: p[flag]), lambda p: p[place])
    both = lambda n, last: F.struct(at(f"{n}_first", "start").alias("starts"), at(last, "end").alias("ends")).alias(n)
    whole = F.array_join(F.transform("_p", lambda p: p["_said"]), "").alias("whole")
    return own.select("doc", whole, both("word", "word_first"), both("line", "line_last"), both("cell", "cell_last"))


def page_texts(streamed: DataFrame) -> DataFrame:
    """(doc, page, start, text) of each page; a document's text is its pages' texts with PAGE_BREAK between them."""
    parts = F.array_sort(F.collect_list(F.struct("end", F.when(F.col("kind") == _WORD, 1).otherwise(0).alias("w"), F.coalesce("row", F.lit(-1)).alias("r"), F.coalesce("col", F.lit(-1)).alias("c"), "sep", "text")))
    return streamed.groupBy("doc", "page").agg(F.min("start").alias("start"), F.array_join(F.transform(parts, lambda p: F.concat(p["sep"], p["text"])), "").alias("text"))


def with_header_paths(cells: DataFrame) -> DataFrame:
    """cells (doc, page, table, row, col, col_span, header, text) with path: the texts of the header cells above that reach over all their columns."""
    key = ["doc", "page", "table"]
    said = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    heads = cells.where("header").select(*key, F.col("row").alias("_r"), F.col("col").alias("_c"), (F.col("col") + F.col("col_span")).alias("_e"), said.alias("_t")).where("_t <> ''")
    above = cells.select(*key, "row", "col", "col_span").join(heads, key).where((F.col("_r") < F.col("row")) & (F.col("_c") <= F.col("col")) & (F.col("col") + F.col("col_span") <= F.col("_e")))
    path = above.groupBy(*key, "row", "col").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_c", "_t"))), lambda h: h["_t"]).alias("path"))
    return cells.join(path, [*key, "row", "col"], "left").withColumn("path", F.coalesce("path", F.array().cast("array<string>")))
