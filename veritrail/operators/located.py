"""Extraction by locators: a schema's fields as a specification and back, the tables of a layer as evidence, and located cells as proposals with anchors.

Fields have schema, endpoint, timepoint, arm, quantity, kind, unit, strategy (null: no locator), rows, sections and columns (texts that
name the cell's row, group and column). Cells have doc, page, table, row, col, header, path (texts of the headers above), text, start and end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrail.functions import numbers, similarity, text
from veritrail.plans.session import written

KEY = ["endpoint", "timepoint", "arm", "quantity"]
#: How a value of each kind is read.
READ_AS = {"count": "integer", "decimal": "decimal", "percentage": "percentage", "ratio": "decimal", "p_value": "decimal", "text": "text"}
LOCATOR = "struct<strategy: string, labels: array<string>, section_labels: array<string>, column_labels: array<string>>"
LEAF = f"struct<type: string, locate: {LOCATOR}, not_reported: array<string>>"


def pointer(*parts: Column) -> Column:
    """A JSON pointer of key parts."""
    return F.concat(*(F.concat(F.lit("/"), F.replace(F.replace(p, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))) for p in parts))


def locators(fields: DataFrame) -> DataFrame:
    """Fields that have a locator, with path and locate; columns count for cells of tables only."""
    filled = lambda c: F.when(F.size(F.coalesce(F.col(c), F.array())) > 0, F.col(c))
    locate = F.struct(F.col("strategy"), F.col("rows").alias("labels"), filled("sections").alias("section_labels"), F.when(F.col("strategy") == "table_label", filled("columns")).alias("column_labels"))
    return fields.where("strategy is not null").withColumn("path", pointer(*map(F.col, KEY))).withColumn("locate", locate)


def specification(fields: DataFrame) -> DataFrame:
    """(schema, specification): one JSON document a schema, nested by endpoint, timepoint, arm and quantity, keys in order."""
    leaf = F.struct(F.lit("text").alias("type"), F.col("locate"), F.array(*map(F.lit, numbers.NOT_REPORTED)).alias("not_reported"))
    own = locators(fields).select("schema", *KEY, leaf.alias("node"))
    for part in reversed(KEY):
        outer = ["schema", *KEY[: KEY.index(part)]]
        by_key = lambda a, b: F.when(a[part] < b[part], -1).when(a[part] > b[part], 1).otherwise(0)  # noqa: B023, E731
        nested = F.map_from_entries(F.array_sort(F.collect_list(F.struct(part, "node")), by_key))
        own = own.groupBy(*outer).agg(nested.alias("node"))
        if part != KEY[0]:
            own = own.withColumn("node", F.struct(F.lit("object").alias("type"), F.col("node").alias("fields")))
    return own.select("schema", F.to_json("node").alias("specification"))


def fields_of(specifications: DataFrame) -> DataFrame:
    """(schema, endpoint, timepoint, arm, quantity, path, locate): the fields of specifications, read back from the JSON."""
    kind = f"map<string, {LEAF}>"
    for _ in KEY[:-1]:
        kind = f"map<string, struct<type: string, fields: {kind}>>"
    own = specifications.select("schema", F.from_json("specification", kind).alias("fields"))
    for part in KEY[:-1]:
        done = [c for c in own.columns if c != "fields"]
        own = own.select(*done, F.explode("fields").alias(part, "node")).select(*done, part, "node.fields")
    own = own.select("schema", *KEY[:-1], F.explode("fields").alias(KEY[-1], "node"))
    return own.select("schema", *KEY, pointer(*map(F.col, KEY)).alias("path"), "node.locate")


def evidence(cells: DataFrame) -> DataFrame:
    """Body cells (doc, page, table, row from 1, col, text, label, section, column, start, end) of each table.

    The first rows that hold header cells alone are its header. A row with a label and no value opens a group; group rows one right after the other are nested.
    """
    key = ["doc", "page", "table"]
    said = F.trim(F.coalesce("text", F.lit("")))
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    own = cells.withColumn("text", said)
    rows = own.groupBy(*key, "row").agg(F.min(F.col("header").cast("int")).alias("_h"), F.max(F.when(F.col("col") == 0, flat("text"))).alias("label"), F.max(F.when(F.col("col") != 0, F.length("text")).otherwise(0)).alias("_v"))
    order = Window.partitionBy(*key).orderBy("row")
    rows = rows.withColumn("_h", F.min("_h").over(order) == 1)
    heads = own.join(rows.where("_h").select(*key, "row"), [*key, "row"]).groupBy(*key, "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", flat("text").alias("t")))), lambda h: h["t"]), " ").alias("_above"))
    body = rows.where("not _h").withColumn("_n", F.row_number().over(order)).withColumn("_g", (F.coalesce("label", F.lit("")) != "") & (F.col("_v") == 0))
    opens = F.when(F.col("_g") & ~F.coalesce(F.lag("_g").over(order), F.lit(False)), 1).otherwise(0)
    body = body.withColumn("_run", F.sum(opens).over(order))
    groups = body.where("_g").groupBy(*key, "_run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "label"))), lambda g: g["label"]), " / ").alias("section"))
    body = body.join(groups, [*key, "_run"], "left").select(*key, "row", "_n", "_g", "label", F.when(~F.col("_g"), F.col("section")).alias("section"))
    found = own.join(body, [*key, "row"])
    first = found.groupBy(*key, "col").agg(F.min_by("path", "_n").alias("_path")).join(heads, [*key, "col"], "left")
    path = F.array_join(F.filter("_path", lambda p: p != ""), " ")
    first = first.select(*key, "col", F.when(F.size(F.coalesce("_path", F.array())) > 0, path).otherwise(F.coalesce("_above", F.lit(""))).alias("column"))
    return found.join(first, [*key, "col"]).select(*key, F.col("_n").alias("row"), "col", "text", "label", "section", "column", "start", "end")


def near_labels(labels: DataFrame, wanted: DataFrame, least: float) -> DataFrame:
    """(schema, label, alias, _fl, _fa): pairs that share a folded word, all with a token set ratio of at least `least` (0 to 1) among them, and few others.

    Such texts a and b hold one another's words; or one's words but for a rest so short that of its rarest words one is shared; or
    they differ by `d` single insertions and deletions at most: then of d + 1 parts of a's rarest word one stands unchanged in b, and
    the lengths are close, and as far apart as d is odd or even.
    """
    least -= 1e-9
    parts = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))
    counts = labels.select("schema", F.explode(parts(F.col("_fl"))).alias("w")).groupBy("schema", "w").agg(F.count(F.lit(1)).alias("f"))

    def ranked(df: DataFrame, name: str, folded: str, to: str) -> DataFrame:
        each = df.withColumn("w", F.explode(parts(F.col(folded)))).join(counts, ["schema", "w"], "left")
        words = F.array_sort(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "w")))
        own = each.groupBy("schema", name, folded).agg(F.transform(words, lambda x: x["w"]).alias(f"{to}w"))
        n = F.length(F.array_join(f"{to}w", " "))
        rest = F.floor(2 * n * (1 - least) / (2 - least) + 1e-6)
        return written(own.withColumn(f"{to}n", n).withColumn(f"{to}first", F.slice(f"{to}w", F.lit(1), (F.floor(rest / 2) + 1).cast("int"))))

    a, b = ranked(wanted, "alias", "_fa", "a"), ranked(labels, "label", "_fl", "b")
    side = lambda df, c: df.withColumn("w", F.explode(c))
    out = ["schema", "label", "alias", "_fl", "_fa"]
    shared = side(a, "afirst").join(side(b, "bw"), ["schema", "w"]).select(out).union(side(a, "aw").join(side(b, "bfirst"), ["schema", "w"]).select(out))
    n, m = F.col("an"), F.col("bn")
    sizes = F.sequence(F.floor(n * least / (2 - least)), F.ceil(n * (2 - least) / least))
    edits = F.floor((1 - least) * (n + m) + 1e-6)
    sized = side(a, "aw").drop("w").distinct().withColumn("bn", F.explode(sizes)).withColumn("d", (edits - (edits + n + m) % 2).cast("int")).where("d >= 1 and abs(an - bn) <= d")
    word = F.get("aw", F.lit(0))
    cut = lambda i: F.floor(i * F.length(word) / (F.col("d") + 1) + 1e-9).cast("int")
    part = F.exists(F.sequence(F.lit(0), F.col("d")), lambda i: F.contains("_fl", F.substr(word, cut(i) + 1, cut(i + 1) - cut(i))))
    edited = sized.join(b.withColumn("bn", F.col("bn").cast("long")), ["schema", "bn"]).where(F.arrays_overlap("aw", "bw") & part).select(out)
    return shared.union(edited).distinct()


def located(cells: DataFrame, fields: DataFrame, threshold: float = 0.75, gap: float = 0.03) -> DataFrame:
    """(doc, schema, path, status, cell): the evidence cell that fits each locator best. cells: evidence with a column schema.

    Label, section and column are compared as the other readings do; only labels that share a folded word with a locator's are. Another value within the gap makes a field ambiguous.
    Where a cell of each document fits a locator wholly, only labels within the gap can matter, so others aren't compared.
    """
    fold = lambda c: F.array_join(text.words_folded(F.coalesce(c, F.lit(""))), " ")
    words = lambda c: F.explode(F.array_distinct(F.filter(F.split(c, " "), lambda w: w != "")))
    like = lambda a, b: similarity.token_set_ratio(a, b) / 100
    value = written(cells.where("col > 0"))
    plan = written(locators(fields).select("schema", "path", F.explode("locate.labels").alias("alias"), F.col("locate.section_labels").alias("_s"), F.col("locate.column_labels").alias("_c")))
    labels = written(value.select("schema", "label").distinct().withColumn("_fl", fold(F.col("label"))))
    wanted = written(plan.select("schema", "alias").distinct().withColumn("_fa", fold(F.col("alias"))))
    best = lambda c, wants: F.when(F.col(wants).isNull(), F.lit(1.0)).otherwise(F.coalesce(F.col(c), F.lit(0.0)))

    def named(df: DataFrame, c: str, wants: str, name: str) -> DataFrame:
        """The best likeness of a cell's text and any of the texts wanted, for each pair of them once."""
        kinds = df.where(F.col(wants).isNotNull()).select(c, F.explode(wants).alias("_w")).distinct()
        scored = kinds.withColumn("_x", like(fold(F.col(c)), fold(F.col("_w")))).select(F.coalesce(F.col(c), F.lit("")).alias("_k"), "_w", "_x")
        every = df.where(F.col(wants).isNotNull()).select(F.coalesce(F.col(c), F.lit("")).alias("_k"), F.col(wants).alias("_ws")).distinct()
        top = every.withColumn("_w", F.explode("_ws")).join(scored, ["_k", "_w"]).groupBy("_k", "_ws").agg(F.max("_x").alias(name))
        return df.join(top, (F.coalesce(F.col(c), F.lit("")) == top["_k"]) & (F.col(wants) == top["_ws"]), "left").drop("_k", "_ws")

    def fits(met: DataFrame) -> DataFrame:
        """(doc, schema, path, score, cell) from the threshold on, of pairs (schema, label, alias, _l)."""
        pairs = written(met.join(plan, ["schema", "alias"]).join(value, ["schema", "label"]))
        pairs = named(named(pairs, "section", "_s", "_sx"), "column", "_c", "_cx")
        score = F.col("_l") * (0.7 + 0.3 * best("_sx", "_s")) * best("_cx", "_c")
        cell = F.struct("page", "table", "row", "col", "text", "start", "end")
        return pairs.select("doc", "schema", "path", F.round(score, 9).alias("score"), cell.alias("cell")).where(F.col("score") >= threshold)

    equal = labels.join(wanted, (labels["schema"] == wanted["schema"]) & (F.col("_fl") == F.col("_fa"))).where("_fl <> ''").select(labels["schema"], "label", "alias", F.lit(1.0).alias("_l"))
    whole = fits(equal).where("score = 1").select("schema", "path", "doc").distinct().groupBy("schema", "path").agg(F.count(F.lit(1)).alias("n"))
    docs = value.select("schema", "doc").distinct().groupBy("schema").agg(F.count(F.lit(1)).alias("n"))
    settled = whole.join(docs, ["schema", "n"]).select("schema", "path")
    open_ = written(plan.join(settled, ["schema", "path"], "left_anti").select("schema", "alias").distinct())
    every, near = wanted.join(open_, ["schema", "alias"], "left_semi"), wanted.join(open_, ["schema", "alias"], "left_anti")
    met = labels.withColumn("w", words(F.col("_fl"))).join(every.withColumn("w", words(F.col("_fa"))), ["schema", "w"]).select("schema", "label", "alias", "_fl", "_fa").distinct()
    met = met.union(near_labels(labels, near, max(threshold, 1 - gap)))
    scored = fits(met.withColumn("_l", like(F.col("_fl"), F.col("_fa"))).where(F.col("_l") >= threshold).drop("_fl", "_fa"))
    by_value = scored.groupBy("doc", "schema", "path", "cell.text").agg(F.max("score").alias("score"), F.min_by("cell", F.struct(-F.col("score"), "cell")).alias("cell"))
    order = Window.partitionBy("doc", "schema", "path").orderBy(F.desc("score"), "cell")
    ranked = by_value.withColumn("_n", F.row_number().over(order)).withColumn("_next", F.lead("score").over(order)).where("_n = 1")
    return ranked.select("doc", "schema", "path", F.when(F.col("score") - F.col("_next") < gap, "ambiguous").otherwise("extracted").alias("status"), "cell")


def read_value(raw: Column, kind: Column) -> Column:
    """struct(value, status, message) of a cell by the kind of its field; a p-value keeps its comparator."""
    plain = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\s+", " "))
    bare = F.replace(plain, F.lit(" "))
    read = lambda as_: numbers.parse_value(plain, numbers.Scalar(as_, not_reported=tuple(numbers.NOT_REPORTED)))
    of = lambda as_: kind.isin([k for k, v in READ_AS.items() if v == as_])
    parsed = F.when(of("integer"), read("integer")).when(of("decimal"), read("decimal")).when(of("percentage"), read("percentage")).otherwise(read("text"))
    compared = F.struct(bare.alias("value"), F.lit("extracted").alias("status"), F.lit(None).cast("string").alias("message"))
    return F.when((kind == "p_value") & bare.rlike("^[<>≤≥]"), compared).otherwise(F.struct(parsed["value"].alias("value"), parsed["status"].alias("status"), parsed["message"].alias("message")))


def proposals(documents: DataFrame, fields: DataFrame, found: DataFrame) -> DataFrame:
    """(doc, schema, path, status, value, unit, quote, message, start, end) of each field of each document (doc, schema).

    A mark for what isn't reported is a missing value with its cell; a value that can't be read is invalid; an anchor (start, end) is the value's own
    token if it stands in the cell once, else the whole cell, and has to print the value.
    """
    own = documents.join(fields.withColumn("path", pointer(*map(F.col, KEY))), "schema").select("doc", "schema", "path", "kind", "unit", "strategy")
    own = own.join(found.select("doc", "schema", "path", F.col("status").alias("_status"), "cell"), ["doc", "schema", "path"], "left")
    raw = F.col("cell.text")
    once_a_row = lambda c: F.explode(F.array(c))  # noqa: E731  what stands in many expressions below is worked out once
    own = own.withColumn("_r", once_a_row(read_value(raw, F.col("kind"))))
    problem = reduce(lambda c, k: c.when(F.col("kind") == k, numbers.well_formed(F.col("_r.value"), k)), ["count", "percentage", "ratio", "p_value", "text"], F.when(F.lit(False), F.lit(None).cast("string")))
    own = own.withColumn("_bad", once_a_row(F.when(F.col("_r.status") == "invalid", F.col("_r.message")).when(F.col("_r.status") == "extracted", problem)))
    token = F.concat(F.lit(r"(?<![0-9.])\Q"), F.col("_r.value"), F.lit(r"\E(?![0-9.])"))
    ascii_ = F.translate(raw, numbers.MINUS, "-" * len(numbers.MINUS))
    once = (F.col("kind") != "text") & (F.size(F.filter(numbers.numbers_in(ascii_), lambda n: n == F.col("_r.value"))) == 1)
    at = F.when(once, F.regexp_instr(ascii_, token)).otherwise(0)
    own = own.withColumn("_at", once_a_row(at))
    start = F.when(F.col("_at") > 0, F.col("cell.start") + F.col("_at") - 1).otherwise(F.col("cell.start"))
    end = F.when(F.col("_at") > 0, start + F.length("_r.value")).otherwise(F.col("cell.end"))
    state = (
        F.when(F.col("strategy").isNull() | F.col("_status").isNull(), "missing").when(F.col("_status") == "ambiguous", "ambiguous").when(F.col("_r.status") == "missing", "missing")
        .when(F.col("_bad").isNotNull(), "invalid").otherwise("extracted")
    )
    message = (
        F.when(F.col("strategy").isNull(), "the schema gives no locator").when(F.col("_status").isNull(), "no cell fits").when(F.col("_status") == "ambiguous", "two cells fit alike")
        .when(F.col("_r.status") == "missing", F.concat(F.lit("the cell prints "), raw)).otherwise(F.col("_bad"))
    )
    out = own.withColumns({"status": state, "message": message})
    only = lambda c: F.when(F.col("status") == "extracted", c)
    return out.select("doc", "schema", "path", "status", only(F.col("_r.value")).alias("value"), only(F.col("unit")).alias("unit"), F.when(F.col("status").isin("extracted", "invalid") | (F.col("_r.status") == "missing"), raw).alias("quote"), "message", only(start).cast("int").alias("start"), only(end).cast("int").alias("end"))
