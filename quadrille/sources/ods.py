"""OpenDocument spreadsheets (SC1-SC16): archives to cells, columns, rows, spans, styles.

One task reads one archive. Repeated rows and columns are expanded, covered cells advance the column, rows in groups are
read like any other; styled cells without a value are kept with vtype no_type.
"""

from __future__ import annotations

import datetime
import io
import os
import zipfile
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import CELL, FIELDS

_NS = "urn:oasis:names:tc:opendocument:xmlns:"
OFFICE, TABLE, TEXT, STYLE, FO = (f"{{{_NS}{n}:1.0}}" for n in ("office", "table", "text", "style", "xsl-fo-compatible"))
DC = "{http://purl.org/dc/elements/1.1/}"
#: In rows without any content, elements that repeat more often are padding of the format: they end where the sheet's content does.
MOST_EMPTY = 10_000


def content(data: bytes, member: str = "content.xml") -> ElementTree.Element:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return ElementTree.fromstring(z.read(member))


def _text(cell: ElementTree.Element) -> str:
    return "".join(" ".join("".join(p.itertext()).split()) for p in cell.findall(f"{TEXT}p"))


def _date(text: str) -> datetime.date | None:
    try:
        return datetime.date.fromisoformat(text[:10]) if len(text) == 10 else None
    except ValueError:
        return None


def value_of(cell: ElementTree.Element) -> dict:
    """SC8, SC9: vtype and the value column that holds it."""
    kind, raw = cell.get(f"{OFFICE}value-type"), cell.get(f"{OFFICE}value")
    if kind in ("float", "percentage", "currency"):
        try:
            return {"vtype": kind, "num": float(raw)}
        except (TypeError, ValueError):
            return {"vtype": "string", "str": _text(cell)}
    if kind == "date":
        text = cell.get(f"{OFFICE}date-value") or ""
        day = _date(text)
        return {"vtype": "date", "dt": day, "str": None if day else text}
    if kind == "boolean":
        return {"vtype": "boolean", "bool": cell.get(f"{OFFICE}boolean-value") == "true"}
    if kind == "time":
        return {"vtype": "time", "str": cell.get(f"{OFFICE}time-value")}
    if kind == "string":
        text = _text(cell)
        err = text[1:] if text.startswith("#") and text[1:] in ("DIV/0!", "N/A", "REF!", "VALUE!", "NAME?") else None
        return {"vtype": "string", "str": cell.get(f"{OFFICE}string-value") or text} if err is None else {"vtype": "string", "err": err}
    return {"vtype": "no_type"}


def annotations(cell: ElementTree.Element) -> list[dict]:
    """SC10: date, author (the first paragraph if no creator is named), text."""
    out = []
    for a in cell.findall(f"{OFFICE}annotation"):
        lines = ["".join(p.itertext()) for p in a.findall(f"{TEXT}p")]
        author, when = a.findtext(f"{DC}creator"), a.findtext(f"{DC}date")
        if author is None and lines:
            author, lines = lines[0], lines[1:]
        try:
            ts = datetime.datetime.fromisoformat(when.split(".")[0]) if when else None
        except ValueError:
            ts = None
        out.append({"ts": ts, "author": author, "text": "\n".join(lines)})
    return out


def sheets_of(root: ElementTree.Element) -> Iterator[ElementTree.Element]:
    for t in root.iter(f"{TABLE}table"):
        if t.get(f"{TABLE}name"):
            yield t


def _filled(cell: ElementTree.Element) -> bool:
    """A value, text, note or formula."""
    return len(cell) > 0 or cell.get(f"{TABLE}formula") is not None or value_of(cell)["vtype"] != "no_type"


def _used(sheet: ElementTree.Element) -> tuple[int, int]:
    """The last column and row with content."""
    y = used_x = used_y = 0
    for row in sheet.iter(f"{TABLE}table-row"):
        y, x = y + int(row.get(f"{TABLE}number-rows-repeated", 1)), 0
        for cell in row:
            if cell.tag in (f"{TABLE}table-cell", f"{TABLE}covered-table-cell"):
                x += int(cell.get(f"{TABLE}number-columns-repeated", 1))
                if _filled(cell):
                    used_x, used_y = max(used_x, x), y
    return used_x, used_y


def read_cells(url: str, data: bytes) -> Iterator[tuple[str, dict]]:
    """('cell' or 'span', fields) of one archive."""
    for sheet in sheets_of(content(data)):
        name, y = sheet.get(f"{TABLE}name"), 1
        used_x, used_y = _used(sheet)
        for row in sheet.iter(f"{TABLE}table-row"):
            times, x, found = int(row.get(f"{TABLE}number-rows-repeated", 1)), 1, []
            filled = any(_filled(c) for c in row)
            for cell in row:
                if cell.tag not in (f"{TABLE}table-cell", f"{TABLE}covered-table-cell"):
                    continue
                n = int(cell.get(f"{TABLE}number-columns-repeated", 1))
                notes, style, value = annotations(cell), cell.get(f"{TABLE}style-name"), value_of(cell)
                formula = cell.get(f"{TABLE}formula")
                if value["vtype"] != "no_type" or notes or formula or style:
                    padding = not filled and n * times > MOST_EMPTY
                    for i in range(min(n, used_x - x + 1) if padding else n):
                        found.append((used_y if padding else None, "cell", {"workbook": url, "sheet": name, "x": x + i, "formula": formula, "style": style or "default", "annotations": notes or None} | value))
                w, h = int(cell.get(f"{TABLE}number-columns-spanned", 1)), int(cell.get(f"{TABLE}number-rows-spanned", 1))
                if w * h > 1:
                    for i in range(n):
                        found.append((None, "span", {"workbook": url, "sheet": name, "sx": x + i, "ex": x + i + w - 1, "h": h}))
                x += n
            ends = [last for last, *_ in found]
            for k in range((times if None in ends else min(times, max(0, max(ends) - y + 1))) if found else 0):
                for last, kind, f in found:
                    if last is None or y + k <= last:
                        yield kind, f | ({"y": y + k} if kind == "cell" else {"sy": y + k, "ey": y + k + f["h"] - 1})
            y += times


def cells_of_files(files: DataFrame) -> DataFrame:
    """files: path, content (Spark's binaryFile). The cell table; archives that can't be read give nothing."""

    def run(frames):
        for pdf in frames:
            for url, data in zip(pdf["path"], pdf["content"]):
                try:
                    rows = [f for kind, f in read_cells(url, data) if kind == "cell"]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    rows = []
                for at in range(0, len(rows), 10_000):
                    yield pd.DataFrame([[r.get(c) for c in FIELDS] for r in rows[at : at + 10_000]], columns=FIELDS, dtype=object)

    return files.select("path", "content").mapInPandas(run, CELL)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).repartition("path")


def read_ods(spark: SparkSession, path: str) -> DataFrame:
    """SC2: the cells of all workbooks under path."""
    return cells_of_files(_files(spark, path))


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """SC7: merged cells with their base."""
    from ..operators.grid import expand_spans

    def run(frames):
        for pdf in frames:
            for url, data in zip(pdf["path"], pdf["content"]):
                rows = [f for kind, f in read_cells(url, data) if kind == "span"]
                yield pd.DataFrame([[r[c] for c in ("workbook", "sheet", "sx", "sy", "ex", "ey")] for r in rows], columns=["workbook", "sheet", "sx", "sy", "ex", "ey"])

    return expand_spans(_files(spark, path).select("path", "content").mapInPandas(run, "workbook string, sheet string, sx int, sy int, ex int, ey int"))


def read_layout(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """SC3-SC5, SC11: sheet, col, row and style tables."""
    schemas = {
        "sheet": "workbook string, sheet string, style string", "col": "workbook string, sheet string, x int, style string",
        "row": "workbook string, sheet string, y int, style string", "style": "workbook string, name string, props map<string,string>",
    }

    def rows_of(what: str, url: str, data: bytes) -> list[tuple]:
        root, out = content(data), []
        if what == "style":
            names = {f"{FO}font-weight": "font_weight", f"{STYLE}font-name": "font_name", f"{FO}font-size": "font_size", f"{STYLE}column-width": "column_width", f"{FO}background-color": "cell_color"}
            for s in root.iter(f"{STYLE}style"):
                props = {names[k]: v for p in s for k, v in p.attrib.items() if k in names}
                out.append((url, s.get(f"{STYLE}name"), {"name": s.get(f"{STYLE}name"), **props}))
            return out
        for sheet in sheets_of(root):
            name = sheet.get(f"{TABLE}name")
            if what == "sheet":
                out.append((url, name, sheet.get(f"{TABLE}style-name")))
                continue
            at, tag, count = 1, f"{TABLE}table-{'column' if what == 'col' else 'row'}", f"{TABLE}number-{'columns' if what == 'col' else 'rows'}-repeated"
            for e in sheet.iter(tag):
                n = int(e.get(count, 1))
                out.append((url, name, at, at + n - 1, e.get(f"{TABLE}style-name")))
                at += n
        return out

    def table(what: str) -> DataFrame:
        at = {"col": "x", "row": "y"}.get(what)
        read = schemas[what].replace(f"{at} int", "low int, high int")  # elements that repeat are expanded by Spark

        def run(frames):
            for pdf in frames:
                rows = [r for url, data in zip(pdf["path"], pdf["content"]) for r in rows_of(what, url, data)]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in read.split(", ")])

        out = _files(spark, path).select("path", "content").mapInPandas(run, read)
        return out.select("workbook", "sheet", F.explode(F.sequence("low", "high")).alias(at), "style") if at else out

    return {what: table(what) for what in schemas}


def external_urls(cells: DataFrame) -> DataFrame:
    """The distinct workbooks that formulas refer to."""
    from ..formula.evaluate import formula_refs

    refs = formula_refs(cells.filter("formula is not null").select("workbook", "sheet", "x", "y", "formula"))
    return refs.select(F.explode("refs").alias("r")).filter("r.url <> ''").select(F.col("r.url").alias("url")).distinct()


def _readable(spark: SparkSession, path: str) -> bool:
    """Whether the file is there, on any of Spark's file systems; addresses of the web are not followed."""
    if path.startswith(("http:", "https:", "ftp:")):
        return False
    try:
        own = spark._jvm.org.apache.hadoop.fs.Path(path)
        return own.getFileSystem(spark._jsc.hadoopConfiguration()).exists(own)
    except (Py4JJavaError, IllegalArgumentException):  # no path, or a file system that is not known
        return False


def load_linked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SC12-SC14: cells of path and of all workbooks linked from there, and workbook(url, status): loaded or REF!. A link
    that can't be read is tried as the same base name with .ods beside the first workbook. Cells are named by the
    link's text. Each round reads the links of the workbooks that the round before found, until none is new."""
    cells = fresh = read_ods(spark, path)
    status = {r.url: "loaded" for r in cells.select(F.col("workbook").alias("url")).distinct().collect()}
    while new := sorted({r.url for r in external_urls(fresh).collect()} - set(status)):
        found = []
        for url in new:
            beside = os.path.join(os.path.dirname(path), os.path.splitext(os.path.basename(url))[0] + ".ods")
            file = next((p for p in (url, beside) if _readable(spark, p)), None)
            status[url] = "loaded" if file else "REF!"
            if file:
                found.append(read_ods(spark, file).withColumn("workbook", F.lit(url)))
        if not found:
            break
        fresh = reduce(DataFrame.unionByName, found)
        cells = cells.unionByName(fresh)
    return cells, spark.createDataFrame(sorted(status.items()), "url string, status string")


def unit_symbols(lines: DataFrame) -> DataFrame:
    """SC16: resource, symbol from the lines (column value) of a Turtle vocabulary with one statement a line."""
    pattern = r'^\s*(\S+)\s+\S*symbol>?\s+"([^"]*)"'
    return lines.filter(F.col("value").rlike(pattern)).select(F.regexp_extract("value", pattern, 1).alias("resource"), F.regexp_extract("value", pattern, 2).alias("symbol"))
