"""Values from laid-out text and tables: candidates, scores, winners, row keys, records, prose spans.

Lines have doc, page, line, text, x0, x1, y0, y1; cells have doc, page, table, row, col, text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrail.functions import similarity, text
from veritrail.operators.folds import dealt
from veritrail.operators.joins import shuffled
from veritrail.operators.ranking import carried
from veritrail.plans.session import written


def inline_candidates(lines: DataFrame) -> DataFrame:
    """'Label: value' inside one line."""
    own = lines.withColumn("label", F.trim(F.regexp_extract("text", r"^([^:]{1,120}):\s*\S", 1))).where("label <> ''")
    return own.select("doc", "page", "line", "label", F.trim(F.regexp_extract("text", r"^[^:]{1,120}:\s*(.*)$", 1)).alias("value"), F.lit("inline").alias("kind"))


def beside_candidates(lines: DataFrame, page_width: float, reach: float = 0.25) -> DataFrame:
    """A label line and the nearest value to its right on the same baseline, within a share of the page width."""
    a = lines.select("doc", "page", F.col("line").alias("line"), F.col("text").alias("label"), F.col("x1").alias("ax"), F.col("y0").alias("ay0"), F.col("y1").alias("ay1"), F.floor(F.col("y1") / 20).alias("band"))
    b = lines.select("doc", "page", F.col("line").alias("value_line"), F.col("text").alias("value"), F.col("x0").alias("bx"), F.col("y0").alias("by0"), F.col("y1").alias("by1"), F.explode(F.array(*[F.floor(F.col("y1") / 20) + d for d in (-1, 0, 1)])).alias("band"))
    near = a.join(shuffled(b), ["doc", "page", "band"]).where((F.col("line") != F.col("value_line")) & (F.col("bx") >= F.col("ax")) & (F.col("bx") - F.col("ax") <= reach * page_width) & (F.abs(F.col("ay1") - F.col("by1")) <= 0.5 * (F.col("ay1") - F.col("ay0"))))
    best = near.groupBy("doc", "page", "line", "label").agg(F.min_by("value", F.struct("bx", "value_line")).alias("value"))
    return best.select("doc", "page", "line", F.regexp_replace("label", r":\s*$", "").alias("label"), "value", F.lit("beside").alias("kind"))


def table_candidates(cells: DataFrame) -> DataFrame:
    """Label from column 0, value from each other column, context from row 0; 'N = x' rows open inferred sections."""
    section = F.when((F.col("col") == 0) & F.col("text").rlike(r"(?i)\(?\bn\s*=\s*\d+"), F.trim(F.regexp_replace("text", r"(?i)\(?\bn\s*=\s*\d+\)?", "")))
    rows = carried(cells.where("col = 0").withColumn("_s", section), ["doc", "page", "table"], "row", "_s", "section")
    labels = rows.select("doc", "page", "table", "row", F.col("text").alias("label"), "section")
    heads = cells.where("row = 0").select("doc", "page", "table", "col", F.col("text").alias("column"))
    values = cells.where("row > 0 and col > 0").withColumnRenamed("text", "value")
    return values.join(labels, ["doc", "page", "table", "row"]).join(heads, ["doc", "page", "table", "col"], "left").withColumn("kind", F.lit("table"))


#: Aliases of a specification up to this many are broadcast; beyond, Spark chooses the join.
MOST_ALIASES = 10_000


def scored(candidates: DataFrame, fields: DataFrame) -> DataFrame:
    """fields (field, aliases, section, column): label likeness x (0.7 + 0.3 section) x column; best alias of each.

    Texts are compared once for each pair of different texts, not for each candidate: labels, sections and columns come back in many documents.
    """
    own = candidates
    for c in ("section", "column"):
        if c not in own.columns:
            own = own.withColumn(c, F.lit(None).cast("string"))
    wanted = written(fields.select("field", F.explode("aliases").alias("alias"), F.col("section").alias("want_section"), F.col("column").alias("want_column")))
    few = wanted.count() <= MOST_ALIASES
    sent = lambda df: F.broadcast(df) if few else df
    fold = lambda c: F.array_join(text.words_folded(c), " ")

    def likeness(column: str, asked: str, name: str) -> DataFrame:
        """(column, asked, name): how like each text of the candidates is to each text asked for."""
        mine = own.select(F.coalesce(F.col(column), F.lit("")).alias(f"_{column}")).distinct().withColumn("_a", fold(F.col(f"_{column}")))
        theirs = wanted.where(F.col(asked).isNotNull()).select(asked).distinct().withColumn("_b", fold(F.col(asked)))
        pairs = mine.join(sent(theirs)).withColumn(name, similarity.token_set_ratio("_a", "_b") / 100)
        return pairs.select(f"_{column}", asked, name)

    pairs = own.withColumns({f"_{c}": F.coalesce(F.col(c), F.lit("")) for c in ("label", "section", "column")})
    pairs = pairs.join(likeness("label", "alias", "_l"), "_label").join(sent(wanted), "alias")
    pairs = pairs.join(likeness("section", "want_section", "_s"), ["_section", "want_section"], "left").join(likeness("column", "want_column", "_c"), ["_column", "want_column"], "left")
    score = F.col("_l") * (0.7 + 0.3 * F.coalesce("_s", F.lit(1.0))) * F.coalesce("_c", F.lit(1.0))
    return pairs.groupBy("field", *candidates.columns).agg(F.max(score).alias("score"))


def winners(scored_: DataFrame, threshold: float = 0.75, gap: float = 0.03) -> DataFrame:
    """(doc, field, status, value, score, runner_up): ambiguous if another value is within the gap; agreeing values tie freely."""
    best = scored_.where(F.col("score") >= threshold).groupBy("doc", "field", "value").agg(F.max("score").alias("score"))
    top = best.groupBy("doc", "field").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("score", "value")))), 1, 2).alias("t"))
    first, second = F.get("t", F.lit(0)), F.get("t", F.lit(1))
    tie = second.isNotNull() & (first["score"] - second["score"] < gap)
    return top.select("doc", "field", F.when(tie, "ambiguous").otherwise("extracted").alias("status"), F.when(~tie, first["value"]).alias("value"), first["score"].alias("score"), second["value"].alias("runner_up"))


def generated_rows(candidates: DataFrame, pattern: str, column: str, most: int) -> DataFrame:
    """A field for each row whose label fits the pattern: key from its first group, repeated keys numbered, `most` rows a document."""
    own = candidates.where(F.col("label").rlike(pattern)).withColumn("key", text.row_key(F.regexp_extract("label", pattern, 1)))
    own = own.where(F.lower("column") == column.lower())
    order = Window.partitionBy("doc").orderBy("page", "table", "row")
    twin = Window.partitionBy("doc", "key").orderBy("page", "table", "row")
    own = own.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
    n = F.row_number().over(twin)
    return own.withColumn("key", F.when(n > 1, F.concat("key", F.lit("_"), n.cast("string"))).otherwise(F.col("key"))).select("doc", "key", "label", "value", "nth")


def prose(lines: DataFrame, anchor: str, end: str, repeats: float = 0.5) -> DataFrame:
    """(doc, value): lines after one that fits `anchor` up to one that fits `end`; lines on most pages (running heads) don't count."""
    lines = dealt(lines, "doc")
    pages = lines.groupBy("doc").agg(F.countDistinct("page").alias("pages"))
    heads = lines.groupBy("doc", "text").agg(F.countDistinct("page").alias("on")).join(shuffled(pages), "doc").where((F.col("pages") > 2) & (F.col("on") > repeats * F.col("pages"))).select("doc", "text")
    own = lines.join(shuffled(heads), ["doc", "text"], "left_anti")
    place = F.struct("page", "line")
    own = own.withColumn("_p", place).withColumn("_a", F.when(F.col("text").rlike(anchor), place))
    begin = own.groupBy("doc").agg(F.min("_a").alias("begin"))
    own = own.join(shuffled(begin), "doc").where(F.col("_p") > F.col("begin"))
    stop = own.groupBy("doc").agg(F.min(F.when(F.col("text").rlike(end), F.col("_p"))).alias("stop"))
    own = own.join(shuffled(stop), "doc").where(F.col("stop").isNull() | (F.col("_p") < F.col("stop")))
    return own.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "text"))), lambda s: s["text"]), " ").alias("value"))


def records(cells: DataFrame, aliases: dict[str, list[str]], most: int | None = None) -> DataFrame:
    """Rows of the tables whose header holds each field once: (doc, page, table, row, fields); repeated headers and blank rows go."""
    fold = F.lower(F.trim("text"))
    field = F.coalesce(*[F.when(fold.isin([a.lower() for a in names]), F.lit(f)) for f, names in aliases.items()])
    head = cells.where("row = 0").withColumn("field", field).where("field is not null")
    fit = head.groupBy("doc", "page", "table").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("field").alias("d")).where((F.col("n") == len(aliases)) & (F.col("d") == len(aliases)))
    cols = head.join(fit.select("doc", "page", "table"), ["doc", "page", "table"]).select("doc", "page", "table", "col", "field", fold.alias("head"))
    body = cells.where("row > 0").join(cols, ["doc", "page", "table", "col"])
    wide = body.groupBy("doc", "page", "table", "row").agg(*(F.max(F.when(F.col("field") == f, F.col("text"))).alias(f) for f in aliases), F.min((F.lower(F.trim("text")) == F.col("head")).cast("int")).alias("_again"), F.max(F.length(F.trim(F.coalesce("text", F.lit(""))))).alias("_long"))
    out = wide.where("_again = 0 and _long > 0").drop("_again", "_long")
    if most is not None:
        out = out.withColumn("_n", F.row_number().over(Window.partitionBy("doc").orderBy("page", "table", "row"))).where(F.col("_n") <= most).drop("_n")
    return out


def split_merged_rows(cells: DataFrame) -> DataFrame:
    """Rows whose value cells all have as many lines as the label become a row for each line."""
    parts = F.split("text", "\n")
    shape = cells.groupBy("doc", "page", "table", "row").agg(F.min(F.size(parts)).alias("lo"), F.max(F.size(parts)).alias("hi"))
    even = cells.join(shape, ["doc", "page", "table", "row"])
    one = F.when((F.col("lo") == F.col("hi")) & (F.col("hi") > 1), parts).otherwise(F.array("text"))
    out = even.select("doc", "page", "table", "row", "col", F.posexplode(one).alias("sub", "text"))
    return out.select("doc", "page", "table", F.dense_rank().over(Window.partitionBy("doc", "page", "table").orderBy("row", "sub")).alias("row") - 1, "col", F.trim("text").alias("text")).toDF("doc", "page", "table", "row", "col", "text")


def search_lines(lines: DataFrame, query: str) -> DataFrame:
    """Lines with the phrase, else those in whose three-line window all words stand; neighbours share a passage number."""
    words = query.lower().split()
    order = Window.partitionBy("doc").orderBy("page", "line")
    around = F.lower(F.concat_ws(" ", F.lag("text").over(order), "text", F.lead("text").over(order)))
    near = F.lit(True)
    for w in words:
        near = near & F.contains(around, F.lit(w))
    own = lines.withColumn("phrase", F.contains(F.lower("text"), F.lit(query.lower()))).withColumn("near", near).withColumn("n", F.row_number().over(order))
    best = own.groupBy("doc").agg(F.max("phrase").alias("any"))
    hits = own.join(best, "doc").where(F.when(F.col("any"), F.col("phrase")).otherwise(F.col("near")))
    opened = F.when(F.col("n") - F.lag("n").over(order) == 1, 0).otherwise(1)
    return hits.withColumn("_o", opened).withColumn("passage", F.sum("_o").over(order)).select("doc", "page", "line", "text", "passage")


def schema_fields(endpoints: DataFrame, timepoints: DataFrame, quantities: DataFrame, targets: DataFrame) -> DataFrame:
    """The fields of an extraction schema: endpoints x timepoints x quantities x targets of a study, units inherited.

    All four are parts of one small specification, joined on study.
    """
    own = endpoints.join(timepoints, "study").join(quantities, ["study", "endpoint_kind"]).join(targets, ["study", "target_kind"])
    return own.withColumn("unit", F.coalesce("quantity_unit", "endpoint_unit")).select("study", "endpoint", "timepoint", "quantity", "target", "unit")


def interval_problem(estimate: Column, lower: Column, upper: Column, ratio: Column) -> Column:
    """What is wrong with an estimate and its interval: reversed, estimate outside, or a ratio off the centre of logs."""
    half = lambda c: 0.5 * F.pow(F.lit(10.0), -F.when(F.contains(c, F.lit(".")), F.length(F.split_part(c, F.lit("."), F.lit(2)))).otherwise(0))
    e, lo, hi = (c.cast("decimal(20,8)") for c in (estimate, lower, upper))
    width = (F.log(hi) - F.log(lo)) / 2
    slack = half(estimate) / e + (half(lower) / lo + half(upper) / hi) / 2 + 0.05 * width
    off = F.abs(F.log(e) - (F.log(lo) + F.log(hi)) / 2)
    return F.when(lo >= hi, "reversed").when((e < lo) | (e > hi), "outside").when(ratio & (lo > 0) & (off > slack), "off_centre")


def with_inferred(first: DataFrame, second: DataFrame) -> DataFrame:
    """winners of declared candidates, and of inferred ones where the first reading found nothing."""
    b = second.where("status = 'extracted'").select("doc", "field", *(F.col(c).alias(f"_{c}") for c in ("status", "value", "score", "runner_up")))
    both = first.join(b, ["doc", "field"], "full_outer")
    own = F.coalesce(F.col("status"), F.lit("missing")) != "missing"
    pick = lambda c: F.when(own, F.col(c)).otherwise(F.coalesce(f"_{c}", c)).alias(c)
    return both.select("doc", "field", pick("status"), pick("value"), pick("score"), pick("runner_up"), (~own & F.col("_value").isNotNull()).alias("inferred"))


def reread(first: DataFrame, second: DataFrame, fields: DataFrame) -> DataFrame:
    """(doc, field, status, value, inferred): the declared reading of each field, or the inferred one where that may replace it.

    first and second: doc, field, status, value, column (the words above the chosen cell); second has section and supplied (the words that the inferred structure
    adds above the cell) too. fields: field, columns and sections, arrays of the texts that were asked for. The inferred reading is looked at only where the declared
    one found nothing or its column lacks words of each text asked for. It has to be in a section asked for, word for word: its own, or one level of a path
    `a / b`. And it has to have all words of a text asked for, of which those the declared column lacks are supplied by the inferred structure.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)[\p{L}\p{N}]+"), F.lit(0)))
    lacks = lambda alias, c: F.array_except(words(alias), c)
    b = second.where("status <> 'missing'").select("doc", "field", F.col("status").alias("_status"), F.col("value").alias("_value"), words(F.col("column")).alias("_has"), words(F.col("supplied")).alias("_adds"), F.col("section").alias("_section"))
    a = first.select("doc", "field", "status", "value", words(F.col("column")).alias("_had"), (F.col("status") != "missing").alias("_there"))
    own = a.join(b, ["doc", "field"], "left").join(F.broadcast(fields.select("field", "columns", F.col("sections").alias("_asked"))), "field")  # fields are a specification
    columns, asked = F.coalesce("columns", F.array().cast("array<string>")), F.coalesce("_asked", F.array().cast("array<string>"))
    lacking = (F.size(columns) > 0) & F.forall(columns, lambda c: F.size(lacks(c, F.col("_had"))) > 0)
    levels = F.concat(F.array(F.coalesce("_section", F.lit(""))), F.split(F.coalesce("_section", F.lit("")), " / "))
    same = lambda x, y: F.array_join(F.regexp_extract_all(F.lower(x), F.lit(r"(?U)[\p{L}\p{N}]+"), F.lit(0)), " ") == F.array_join(F.regexp_extract_all(F.lower(y), F.lit(r"(?U)[\p{L}\p{N}]+"), F.lit(0)), " ")
    carries = (F.size(asked) == 0) | F.exists(asked, lambda w: F.exists(levels, lambda v: same(w, v)))
    explains = F.exists(columns, lambda c: (F.size(lacks(c, F.col("_has"))) == 0) & (F.size(F.array_except(lacks(c, F.col("_had")), F.col("_adds"))) == 0))
    replaced = F.col("_status").isNotNull() & (~F.col("_there") | lacking) & carries & (~F.col("_there") | explains)
    return own.withColumn("inferred", replaced).select("doc", "field", F.when(F.col("inferred"), F.col("_status")).otherwise(F.col("status")).alias("status"), F.when(F.col("inferred"), F.col("_value")).otherwise(F.col("value")).alias("value"), "inferred")


def nested(results: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(doc, output): field results as one JSON object a document; fields: field -> 'section/key'."""
    sections: dict[str, list[tuple[str, str]]] = {}
    for field, path in fields.items():
        section, _, key = path.rpartition("/")
        sections.setdefault(section, []).append((key, field))
    wide = results.groupBy("doc").agg(*(F.max(F.when((F.col("field") == f) & (F.col("status") == "extracted"), F.col("value"))).alias(f) for f in fields))
    parts = []
    for section, members in sections.items():
        inner = [F.col(f).alias(k) for k, f in members]
        parts += [F.struct(*inner).alias(section)] if section else inner
    return wide.select("doc", F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("output"))
