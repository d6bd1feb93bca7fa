"""Sinks: RIS, spreadsheet-safe CSV, Markdown, content-addressed bundles with a manifest, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The longest text of a spreadsheet cell.
CELL = 32_767


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def ris_lines(records: DataFrame, ids: dict[str, str] | None = None) -> DataFrame:
    """(ordinal, entry): a record as one RIS entry. ids: custom field (C1, C2, C3) -> column."""
    line = lambda tag, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{tag}  - "), c))
    many = lambda tag, c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda v: F.concat(F.lit(f"{tag}  - "), v))
    pmid = F.when(F.col("pmid").isNotNull(), F.concat(F.lit("PMID: "), "pmid"))
    notes = F.array_compact(F.concat(F.coalesce("registry_ids", F.array().cast("array<string>")), F.array(pmid)))
    head = F.array(
        F.when(F.coalesce(F.col("source") == "registry", F.lit(False)), F.lit("TY  - DBASE")).otherwise(F.lit("TY  - JOUR")),
        line("TI", one_line(F.col("title"))),
        line("AN", F.col("provider_record_id")),
        *[line(tag, F.col(c).cast("string")) for tag, c in (ids or {}).items()],
    )
    tail = F.array(line("PY", F.col("year").cast("string")), line("JO", F.col("journal")), line("DO", F.col("doi")), line("AB", one_line(F.col("abstract"))), line("UR", F.when(F.col("pmid").isNotNull(), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), "pmid", F.lit("/")))))
    lines = F.concat(F.array_compact(head), many("AU", F.col("authors")), F.array_compact(tail), many("N1", notes), F.array(F.lit("ER  - "), F.lit("")))
    return records.select("ordinal", F.array_join(lines, "\n").alias("entry"))


def write_ris(records: DataFrame, path: str, ids: dict[str, str] | None = None) -> None:
    ris_lines(records, ids).orderBy("ordinal").select("entry").write.text(path)


def sheet_safe(text: Column) -> Column:
    """A cell that no spreadsheet reads as a formula: control characters go, formulas become texts, long texts are cut."""
    clean = F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")
    return F.substring(F.when(clean.rlike("^[=+@-]") & ~clean.rlike(r"^[+-]?\d+([.,]\d+)?$"), F.concat(F.lit("'"), clean)).otherwise(clean), 1, CELL)


def write_sheet(df: DataFrame, path: str) -> None:
    safe = [sheet_safe(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    df.select(*safe).write.csv(path, header=True)


def markdown(df: DataFrame) -> DataFrame:
    """(line): rows of a Markdown table; the head is markdown_head."""
    cell = lambda c: F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, df.columns)), F.lit(" |")).alias("line"))


def markdown_head(df: DataFrame) -> str:
    return "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)


def write_bundle(tables: dict[str, DataFrame], path: str, cutoff: int | None = None) -> DataFrame:
    """Every table as Parquet up to a ledger sequence, and the manifest (file, sha256, bytes) of what was written."""
    spark = None
    for name, df in tables.items():
        spark = df.sparkSession
        own = df.where(F.col("event_seq") <= cutoff) if cutoff is not None and "event_seq" in df.columns else df
        own.write.parquet(f"{path}/{name}")
    return manifest(spark, path)


def manifest(spark, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def verify_bundle(spark, path: str, expected: DataFrame) -> DataFrame:
    """Files that are missing, added or changed against a manifest."""
    now = manifest(spark, path).select("file", F.col("sha256").alias("now"))
    both = expected.select("file", "sha256").join(now, "file", "full_outer")
    kind = F.when(F.col("now").isNull(), "missing").when(F.col("sha256").isNull(), "added").when(F.col("now") != F.col("sha256"), "changed")
    return both.select("file", kind.alias("problem")).where("problem is not null")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], seq: str | None = None) -> DataFrame:
    """current with each key's last change in place of its row; both sides are shuffled once, on the keys."""
    last = changes
    if seq is not None:
        row = F.struct(*changes.columns)
        last = changes.groupBy(*keys).agg(F.max_by(row, seq).alias("_row")).select("_row.*")
    return current.join(last.select(*keys), keys, "left_anti").unionByName(last)


def insert_new(current: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return current.unionByName(rows.join(current.select(*keys), keys, "left_anti"))


FLOW_BOXES = [("Identified", "identified"), ("Duplicates removed", "duplicates"), ("Screened", "screened"), ("Excluded on title", "excluded_title"), ("Assessed in full", "assessed"), ("Excluded in full", "excluded_full"), ("Included", "included")]


def flow_svg(flow: DataFrame, title: str) -> str:
    """A flow diagram as SVG from the (metric, n) rows of a screening flow: a few rows, drawn on the driver."""
    from xml.sax.saxutils import escape

    n = {r["metric"]: r["n"] for r in flow.select("metric", "n").collect()}
    out, y = [], 40
    for label, metric in FLOW_BOXES:
        side = metric in ("duplicates", "excluded_title", "excluded_full")
        x = 260 if side else 20
        out.append(f'<rect x="{x}" y="{y}" width="220" height="36" fill="none" stroke="black"/><text x="{x + 10}" y="{y + 23}">{escape(label)} (n = {n.get(metric, 0)})</text>')
        y += 0 if side else 52
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="500" height="{y + 20}" font-size="13"><text x="20" y="24">{escape(title)}</text>{"".join(out)}</svg>'
