"""Spreadsheet files as tables, and tables as spreadsheet files: zip and XML, values only."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession

from veritrail.sources.sinks import CELL

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
MOST_CELLS = 5_000_000


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _named_sheets(book: zipfile.ZipFile) -> dict[str, str]:
    """Sheet name -> its part, in the order of the workbook."""
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheets = ET.fromstring(book.read("xl/workbook.xml")).iterfind("m:sheets/m:sheet", NS)
    return {s.get("name"): "xl/" + targets[s.get(rel)].removeprefix("/xl/") for s in sheets}


def read_sheet(data: bytes, name: str | None = None) -> list[list[str]]:
    """Rows of the first sheet, or of the one of that name, as texts."""
    book = zipfile.ZipFile(io.BytesIO(data))
    names = book.namelist()
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in si.iter(f"{{{NS['m']}}}t")) for si in ET.fromstring(book.read("xl/sharedStrings.xml")).findall("m:si", NS)]
    if name is None:
        sheet = sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))[0]
    else:
        sheet = _named_sheets(book).get(name)
        if sheet is None:
            raise ValueError(f"no sheet {name!r}")
    rows, cells = [], 0
    for row in ET.fromstring(book.read(sheet)).iter(f"{{{NS['m']}}}row"):
        out: list[str] = []
        for i, c in enumerate(row.findall("m:c", NS)):
            cells += 1
            if cells > MOST_CELLS:
                raise ValueError("the sheet has too many cells")
            at = _column(c.get("r")) if c.get("r") else i
            out += [""] * (at + 1 - len(out))
            value = c.findtext("m:v", "", NS)
            out[at] = shared[int(value)] if c.get("t") == "s" else "".join(t.text or "" for t in c.iter(f"{{{NS['m']}}}t")) if c.get("t") == "inlineStr" else value
        rows.append(out)
    return rows


def write_workbook_bytes(sheets: dict[str, list[list]]) -> bytes:
    """A workbook of sheets (name -> rows); every cell is a text, so nothing is a formula."""
    cell = lambda v: f'<c t="inlineStr"><is><t xml:space="preserve">{escape(re.sub("[^\\t\\n\\r\\x20-\\uD7FF\\uE000-\\uFFFD\\U00010000-\\U0010FFFF]", "", str(v))[:CELL])}</t></is></c>' if v is not None else "<c/>"
    office, package = "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    numbers = range(1, len(sheets) + 1)
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>'
        + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in numbers) + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{NS["m"]}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, n in zip(numbers, sheets)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers) + "</Relationships>",
    }
    for i, rows in zip(numbers, sheets.values()):
        body = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows)
        parts[f"xl/worksheets/sheet{i}.xml"] = f'<worksheet xmlns="{NS["m"]}"><sheetData>{body}</sheetData></worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), '<?xml version="1.0" encoding="UTF-8"?>' + text)
    return out.getvalue()


def write_sheet_bytes(header: list[str], rows: list[list]) -> bytes:
    """A workbook with one sheet of records."""
    return write_workbook_bytes({"records": [header, *rows]})


#: Rows of a sheet that one file, and one task, holds.
MOST_ROWS = 100_000


def write_working_sheets(rows: DataFrame, by: str, folder: str, cover: list[tuple[str, str]], criteria: list[tuple], most: int = MOST_ROWS) -> DataFrame:
    """(by, part, path, rows, sha256) of the workbooks written to folder: one for each value of `by`, and more where it has over `most` rows.

    Each has the rows as sheet records, a sheet cover of facts (label, value) with its own number of rows and part, and a sheet criteria (id, kind, text).
    Rows stand in the order of their columns. Files are named by value and part, so a task that runs again writes the same file.
    """
    import hashlib
    from urllib.parse import quote

    import pandas as pd
    from pyarrow import fs
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window

    columns = [c for c in rows.columns if c != by]
    nth = F.row_number().over(Window.partitionBy(by).orderBy(*columns)) - 1
    own = rows.withColumn("_part", F.floor(nth / most).cast("int")).withColumn("_nth", nth)

    def write(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_nth")
        value, part = group[by].iloc[0], int(group["_part"].iloc[0])
        texts = [[None if pd.isna(v) else str(v) for v in r] for r in group[columns].itertuples(index=False)]
        facts = [["Rows of", str(value)], ["Part", str(part + 1)], ["Rows", str(len(texts))], *map(list, cover)]
        data = write_workbook_bytes({"records": [columns, *texts], "cover": facts, "criteria": [["id", "kind", "text"], *map(list, criteria)]})
        where, path = fs.FileSystem.from_uri(f"{folder}/{quote(str(value), safe='')}-{part}.xlsx")
        where.create_dir(path.rpartition("/")[0], recursive=True)
        with where.open_output_stream(path, compression=None) as out:
            out.write(data)
        return pd.DataFrame([(value, part, path, len(texts), hashlib.sha256(data).hexdigest())], columns=[by, "part", "path", "rows", "sha256"])

    return own.groupBy(by, "_part").applyInPandas(write, f"`{by}` {dict(rows.dtypes)[by]}, part int, path string, rows long, sha256 string")


def sheet_table(spark: SparkSession, path: str, needed: list[str]) -> DataFrame:
    """The first sheet of each workbook at path: (file, row, columns of the header); blank rows go, needed columns must be there."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            for file, data in zip(batch["path"], batch["content"]):
                rows = read_sheet(data)
                header = [h.strip() for h in rows[0]] if rows else []
                if missing := [n for n in needed if n not in header]:
                    raise ValueError(f"{file}: no column {missing[0]!r}")
                out = [(file, i, *((r[header.index(n)] if header.index(n) < len(r) else "") for n in needed)) for i, r in enumerate(rows[1:], 2) if any(c.strip() for c in r)]
                yield pd.DataFrame(out, columns=["file", "row", *needed])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, row int, " + ", ".join(f"`{n}` string" for n in needed))
