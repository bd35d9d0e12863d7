"""Workbooks (.xlsx) as rows, and the finance tables that they hold.

A workbook is a zip of XML parts, so no library is needed: every file is one task's work, read
part by part.  Values come as text (dates as ISO, whole numbers without decimals), keyed by
the first row's headers; columns without a header and rows without a value go.  The
finance tables are projections over these rows and take sheets exported as CSV as well.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import norm

LARGEST_PART = 1 << 29  # bytes of one unpacked part; a larger one is refused, as it is a bomb
ROWS = "path string, file string, sheet string, row int, cells map<string,string>"
_DAY_ZERO = dt.datetime(1899, 12, 30)
#: Number formats that the file format defines as dates and times.
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}
_LETTERS = re.compile("[A-Z]+")


def _part(book: zipfile.ZipFile, name: str) -> bytes:
    if book.getinfo(name).file_size > LARGEST_PART:
        raise ValueError(f"{name} unpacks to more than {LARGEST_PART} bytes")
    raw = book.read(name)
    if b"<!DOCTYPE" in raw[:4096]:
        raise ValueError(f"{name} declares a document type")
    return raw


def _elements(raw: bytes, tag: str) -> Iterator[ElementTree.Element]:
    """Elements of that local name; each is emptied when the next one is asked for."""
    for _, e in ElementTree.iterparse(io.BytesIO(raw)):
        if e.tag.rpartition("}")[2] == tag:
            yield e
            e.clear()


def _column(reference: str) -> int:
    out = 0
    for c in _LETTERS.match(reference).group():
        out = out * 26 + ord(c) - 64
    return out - 1


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Cell styles that show a number as a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    raw = _part(book, "xl/styles.xml")
    own = {int(e.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", e.get("formatCode", "")) for e in _elements(raw, "numFmt")}
    shows_date = lambda f: f in _DATE_FORMATS or bool(re.search("[ymdh]", own.get(f, ""), re.IGNORECASE))
    styles = next(iter(_elements(raw, "cellXfs")), None)
    return set() if styles is None else {i for i, x in enumerate(styles) if shows_date(int(x.get("numFmtId", 0)))}


def _value(cell: ElementTree.Element, shared: list[str], dates: set[int]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter() if t.tag.rpartition("}")[2] == "t")
    found = next((e.text for e in cell if e.tag.rpartition("}")[2] == "v"), None)
    if found is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(found)]
    if kind == "b":
        return "true" if found == "1" else "false"
    if kind != "n":
        return found
    number = float(found)
    if int(cell.get("s", -1)) in dates:
        when = _DAY_ZERO + dt.timedelta(days=number)
        return when.date().isoformat() if number == int(number) else when.isoformat(sep=" ", timespec="seconds")
    return str(int(number)) if number.is_integer() and abs(number) < 1e15 else found


def sheets(raw: bytes) -> Iterator[tuple[str, list[list[str | None]]]]:
    """(name, rows of values) of every sheet, in the workbook's order."""
    with zipfile.ZipFile(io.BytesIO(raw)) as book:
        parts = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in parts:
            for item in _elements(_part(book, "xl/sharedStrings.xml"), "si"):
                shared.append("".join(t.text or "" for t in item.iter() if t.tag.rpartition("}")[2] == "t"))
        dates = _date_styles(book)
        targets = {e.get("Id"): e.get("Target") for e in _elements(_part(book, "xl/_rels/workbook.xml.rels"), "Relationship")}
        for s in _elements(_part(book, "xl/workbook.xml"), "sheet"):
            target = targets[next(v for k, v in s.attrib.items() if k.endswith("}id"))].lstrip("/")
            rows = []
            for r in _elements(_part(book, target if target.startswith("xl/") else f"xl/{target}"), "row"):
                values: list[str | None] = []
                for c in r:
                    at = _column(c.get("r")) if c.get("r") else len(values)
                    values += [None] * (at - len(values))
                    values.append(_value(c, shared, dates))
                rows.append(values)
            yield s.get("name"), rows


def keyed(rows: list[list[str | None]]) -> Iterator[tuple[int, dict[str, str]]]:
    """Rows behind the header with their values by header."""
    header = [(h or "").strip() for h in rows[0]] if rows else []
    for n, row in enumerate(rows[1:], start=2):
        cells = {h: v for h, v in zip(header, row, strict=False) if h and v is not None}
        if cells:
            yield n, cells


def workbook_rows(spark: SparkSession, root: str, glob: str = "*.xlsx") -> DataFrame:
    """(path, file, sheet, row, cells) of all workbooks below a folder."""
    types = pa.schema([("path", pa.string()), ("file", pa.string()), ("sheet", pa.string()), ("row", pa.int32()), ("cells", pa.map_(pa.string(), pa.string()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                for sheet, rows in sheets(raw):
                    made = [(path, file, sheet, n, list(cells.items())) for n, cells in keyed(rows)]
                    if made:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*made, strict=True), types, strict=True)], schema=types)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select("path", "content").mapInArrow(read, ROWS)


# ---------------------------------------------------------------- finance tables

# Names of files, sheets and headers.
RECEIVABLES, PLANT, BOQ, MEASUREMENTS = "AR Ageing", "Plant Register", "BOQ", "Measurements"
TRIAL_BALANCE, CONTRACT = "Trial_Balance_by_Year", r"BOQ_and_Measurements_Contract_(\d+)$"


def _cell(header: str) -> Column:
    return F.nullif(F.trim(F.try_element_at("cells", F.lit(header))), F.lit(""))


def _rupees(header: str) -> Column:
    """Whole rupees; an empty cell counts 0."""
    return F.coalesce(F.bround(F.regexp_replace(_cell(header), ",", "").try_cast("decimal(24,6)"), 0).cast("bigint"), F.lit(0).cast("bigint"))


def invoice(rows: DataFrame) -> DataFrame:
    """Receivables, one row an invoice."""
    return rows.filter(F.col("sheet") == RECEIVABLES).select(
        _cell("Invoice No").alias("invoice_no"), norm.norm_client(_cell("Client")).alias("client"), norm.parse_date(_cell("Invoice Date")).alias("date"),
        F.year(norm.parse_date(_cell("Invoice Date"))).alias("year"), _rupees("Invoiced (INR)").alias("invoiced"), F.lower(_cell("Status")).alias("status"),
        _rupees("Received (INR)").alias("received"), _rupees("Outstanding (INR)").alias("outstanding"),
    )


def receivables_by_client(rows: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("invoiced", "received", "outstanding")]
    return invoice(rows).filter("client is not null").groupBy("client").agg(*sums, F.count("*").alias("invoices"))


def account(rows: DataFrame) -> DataFrame:
    """Trial balance: one sheet a year; sheets of notes go."""
    books = rows.filter((F.col("file") == TRIAL_BALANCE) & ~F.lower("sheet").startswith("note"))
    return books.select(F.col("sheet").alias("year"), _cell("Account").alias("account"), *[_rupees(f"{c} (INR)").alias(c.lower()) for c in ("Debit", "Credit", "Balance")]).filter("account is not null")


def asset(rows: DataFrame) -> DataFrame:
    """Plant register without its total."""
    kept = rows.filter((F.col("sheet") == PLANT) & _cell("Asset ID").isNotNull() & ~F.upper(_cell("Asset ID")).startswith("TOTAL"))
    return kept.select(
        _cell("Asset ID").alias("asset_id"), _cell("Type").alias("type"), _cell("Make").alias("make"), _cell("Acquired").try_cast("int").alias("acquired"), _rupees("Cost (INR)").alias("cost"),
        _cell("Condition").alias("condition"), _cell("Location").alias("location"), _cell("Ownership").alias("ownership"),
        F.coalesce(F.lower(_cell("Safety Certified")).isin("true", "yes", "y", "1"), F.lit(False)).alias("safety_certified"),
    )


def _contract() -> Column:
    return F.regexp_extract("file", CONTRACT, 1).try_cast("int")


def boq_item(rows: DataFrame) -> DataFrame:
    kept = rows.filter((F.col("sheet") == BOQ) & _contract().isNotNull() & _cell("Item No").isNotNull())
    return kept.select(
        _contract().alias("contract_no"), _contract().alias("pkg"), _cell("Item No").alias("item_no"), _cell("Description").alias("description"), _cell("Unit").alias("unit"),
        _cell("Quantity").try_cast("double").alias("quantity"), _cell("Rate (INR)").try_cast("double").alias("rate"), _rupees("Amount (INR)").alias("amount"),
    )


def measurement(rows: DataFrame) -> DataFrame:
    """Measured quantities; the total's row has no number of a bill."""
    day = norm.parse_date(_cell("Measured On"))
    kept = rows.filter((F.col("sheet") == MEASUREMENTS) & _contract().isNotNull() & _cell("RA No").try_cast("double").isNotNull())
    return kept.select(
        _cell("RA No").try_cast("double").cast("int").alias("ra_no"), day.alias("measured_on"), _cell("Item No").alias("item_no"), _cell("Description").alias("description"),
        _cell("Qty Measured").try_cast("double").alias("qty"), _rupees("Amount (INR)").alias("amount"), _contract().alias("contract"), _contract().alias("pkg"), F.year(day).alias("year"),
    )


TABLES = {f.__name__: f for f in (invoice, receivables_by_client, account, asset, boq_item, measurement)}
