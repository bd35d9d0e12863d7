"""Workbooks, stores, and what holds between sources."""

import datetime as dt
import zipfile
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from tessera.operators import store, verify
from tessera.sources import estate, readers, workbook

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def write_book(path, books):
    """A small workbook: shared strings, one date style, booleans and gaps."""
    shared = []

    def cell(value, ref):
        if value is None:
            return ""
        if isinstance(value, bool):
            return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
        if isinstance(value, dt.date):
            return f'<c r="{ref}" s="1"><v>{(value - dt.date(1899, 12, 30)).days}</v></c>'
        if isinstance(value, str):
            shared.append(value)
            return f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>'
        return f'<c r="{ref}"><v>{value}</v></c>'

    with zipfile.ZipFile(path, "w") as z:
        for i, rows in enumerate(books.values()):
            body = "".join(f'<row r="{r}">' + "".join(cell(v, f"{chr(65 + c)}{r}") for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {NS}><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/workbook.xml", f"<workbook {NS}><sheets>" + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(books)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(len(books))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si><t>{escape(s)}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {NS}><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>')


@pytest.fixture(scope="module")
def books(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("books")
    (root / "deep").mkdir()
    day = dt.date(2020, 5, 3)
    write_book(root / "Receivables_Ageing.xlsx", {"AR Ageing": [
        ["Invoice No", "Client", None, "Invoice Date", "Invoiced (INR)", "Status", "Received (INR)", "Outstanding (INR)"],
        ["I1", "Water Board (PSU)", "x", day, 1000, " Paid ", 400, 600], [None] * 8, ["I2", "Water Board", None, "04/05/2021", 50.5, None, None, 50], ["I3", None, None, None, 7, "open", 0, 7]]})
    write_book(root / "Trial_Balance_by_Year.xlsx", {"2019": [["Account", "Debit (INR)", "Credit (INR)", "Balance (INR)"], ["Cash & bank", 5, 0, 5], [None, 1, 1, 1]], "2020": [["Account", "Debit (INR)"], ["Cash", 9]], "Notes": [["Account"], ["none"]]})
    write_book(root / "Plant_and_Machinery_Register.xlsx", {"Plant Register": [
        ["Asset ID", "Type", "Make", "Acquired", "Cost (INR)", "Condition", "Location", "Ownership", "Safety Certified"], ["A1", "Crane", "Acme", 2015, 100, "good", "Yard", "owned", True], ["TOTAL", None, None, None, 100]]})
    write_book(root / "deep" / "BOQ_and_Measurements_Contract_7.xlsx", {
        "BOQ": [["Item No", "Description", "Unit", "Quantity", "Rate (INR)", "Amount (INR)"], [1, "Earth work", "cum", 2.5, 10, 25]],
        "Measurements": [["RA No", "Measured On", "Item No", "Description", "Qty Measured", "Amount (INR)"], [1, day, 1, "Earth work", 2, 20], ["TOTAL", None, None, None, None, 20]]})
    return workbook.workbook_rows(spark, str(root))


def got(df, *cols, order=None):
    return [tuple(r) for r in (df.orderBy(order) if order else df).select(*(cols or df.columns)).collect()]


def test_finance_tables(books):
    t = {name: fn(books) for name, fn in workbook.TABLES.items()}
    assert got(t["invoice"], order="invoice_no") == [
        ("I1", "Water Board", dt.date(2020, 5, 3), 2020, 1000, "paid", 400, 600), ("I2", "Water Board", dt.date(2021, 5, 4), 2021, 50, None, 0, 50), ("I3", None, None, None, 7, "open", 0, 7)]
    assert got(t["receivables_by_client"]) == [("Water Board", 1050, 400, 650, 2)]
    assert got(t["account"], order="year") == [("2019", "Cash & bank", 5, 0, 5), ("2020", "Cash", 9, 0, 0)]
    assert got(t["asset"]) == [("A1", "Crane", "Acme", 2015, 100, "good", "Yard", "owned", True)]
    assert got(t["boq_item"]) == [(7, 7, "1", "Earth work", "cum", 2.5, 10.0, 25)]
    assert got(t["measurement"]) == [(1, dt.date(2020, 5, 3), "1", "Earth work", 2.0, 20, 7, 7, 2020)]


def test_workbooks_that_are_none(tmp_path):
    write_book(tmp_path / "b.xlsx", {"a": []})
    assert [(n, list(workbook.keyed(rows))) for n, rows in workbook.sheets((tmp_path / "b.xlsx").read_bytes())] == [("a", [])]
    with zipfile.ZipFile(tmp_path / "c.xlsx", "w") as z:
        z.writestr("xl/_rels/workbook.xml.rels", '<!DOCTYPE x [<!ENTITY a "b">]><Relationships/>')
        z.writestr("xl/workbook.xml", "<workbook/>")
    with pytest.raises(ValueError, match="document type"):
        list(workbook.sheets((tmp_path / "c.xlsx").read_bytes()))


def test_stores_and_lookups(spark, tmp_path):
    texts = spark.createDataFrame([("a", "x"), ("b", None)], "doc_id string, text string")
    assert readers.text_of(texts, "a") == "x" and readers.text_of(texts, "b") is None and readers.text_of(texts, "c") is None
    readers.save_store({"t": texts}, str(tmp_path / "store"))
    assert readers.load_store(spark, str(tmp_path / "store"), ["t"])["t"].count() == 2
    readers.write_log(texts, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "DOC-1.txt").write_text("x")
    (tmp_path / "index.csv").write_text("doc_id,title\nDOC-9,nine\n")
    assert got(readers.index(spark, str(tmp_path / "in")), "doc_id") == [("DOC-1",)]
    assert got(readers.index(spark, str(tmp_path / "in"), str(tmp_path / "index.csv"))) == [("DOC-9", "nine")]
    assert got(readers.index(spark, str(tmp_path / "in"), str(tmp_path / "none.csv")), "doc_id") == [("DOC-1",)]


def test_guarded_spelling(spark):
    letters = spark.createDataFrame([("w1", "MERIDIAN & CO."), ("w2", "Other"), ("w3", "X"), (None, "Y")], "work string, client string")
    works = spark.createDataFrame([("w1", "Meridian & Co"), ("w2", "Water Board"), ("w3", None)], "work string, client string")
    assert sorted(got(store.guarded_spelling(letters, "work", "client", works)), key=str) == [("w1", "Meridian & Co"), ("w2", "Other"), ("w3", "X"), (None, "Y")]


def test_people_of_both_sources(spark):
    held = spark.createDataFrame([("A", "PMP", "c2", "2020-01-01", "d2", "E1"), ("A", "CQE", "c1", None, "d1", None), (None, "X", "c3", None, "d3", None)], "name string, credential string, credential_id string, issued string, doc string, employee_id string")
    cvs = spark.createDataFrame([("A", "v1", None, "Lead"), ("B", "v2", "E2", "Clerk")], "name string, doc string, employee_id string, designation string")
    made = {r["name"]: r for r in store.people(held, cvs).collect()}
    assert [(c["credential"], c["doc"]) for c in made["A"]["credentials"]] == [("CQE", "d1"), ("PMP", "d2")]
    assert (made["A"]["employee_id"], made["A"]["designation"], made["A"]["cv_id"]) == ("E1", "Lead", "v1")
    assert (made["B"]["credentials"], made["B"]["employee_id"]) == ([], "E2")
    led = store.works_of(spark.createDataFrame([("A", 2), ("A", 1), ("A", 2), (None, 3)], "lead string, w int"), "lead", "w", "led")
    assert got(led) == [("A", [1, 2])]


def test_inclusion_agreement_and_census(spark):
    a = spark.createDataFrame([(1, "X ", 5), (2, "y", None), (3, "z", 1)], "k int, name string, v int")
    b = spark.createDataFrame([(1, "x", 5), (2, "q", None), (9, "z", 1)], "k int, title string, v int")
    assert sorted(got(verify.agreement(a, b, "k", {"name": "title", "v": "v"}))) == [("name", 2, 1), ("v", 2, 2)]
    assert got(store.not_included(a.select("k"), b.select("k"))) == [(3,)] and store.not_included(a.limit(0), b.withColumnRenamed("title", "name")).count() == 0
    groups = spark.createDataFrame([("x",), ("x",), ("y",)], "g string")
    assert sorted(got(verify.census(groups, "g", {"x": 2, "y": 2, "z": 1}), "g", "found", "pinned")) == [("y", 1, 2), ("z", None, 1)]
    names = spark.createDataFrame([("Water Board",), ("Roads",)], "canon string")
    said = spark.createDataFrame([(" water board",), ("Dams",)], "client string")
    assert sorted(got(store.canonical(said, "client", names, "canon"))) == [("Dams",), ("Water Board",)]


def test_identities_of_the_estate(spark):
    from tests.test_estate import TEXTS

    made = estate.tables(spark.createDataFrame(list(TEXTS.items()), "doc string, text string"))
    found = {(r["table"], r["constraint"]): (r["checked"], r["violated"]) for r in verify.estate_identities(made).collect()}
    assert found["ra_bill", "net = work + gst - retention"] == (1, 0) and found["bank_year", "closing = opening + in - out"] == (1, 0)
    assert found["order_line", "current = awarded + variations"][1] == 0 and found["compliance", "complied + not = all"] == (1, 0)
    assert found["boq_line", "amount = rate * quantity"] == (2, 1)  # the final bill of the fixture prints a figure of its own
    moved = made["variation"].groupBy("contract").agg(F.sum("value_delta").alias("v")).select("v")
    assert store.not_included(made["order_line"].filter("variations = -7").select(F.col("variations").alias("v")), moved).count() == 0
