"""Entity tables from texts laid out as the document templates print them."""

import datetime as dt
import re

import pytest

from tessera.sources import estate

TEXTS = {
    "DOC-BOND-1": "State Union Bank\nBond No: BG/77-1\nIssue Date: 2020-01-10\nTender RFP-12\nfor the work of Canal Lining Works, and a sum not\nexceeding INR 1.50 Cr\nfor 5% (five) valid from 2020-02-01 until 2021-02-01",
    "DOC-CM-1": "Tender Ref: RFP-12 · Canal Lining CM/1\nBid Value INR 2 Cr\n1\nTurnover\nComplied\n2\nRegistration\nN/A\nN/A\n3\nStaff\nNot Complied",
    "DOC-CERT-1": "Certificate No: Q-1\nISO 9001:2015\nCertification Body\nTUV\nInitial Certification Date\n2020-01-01\nValid Until\n2023-01-01\nInitial Certification\n2020-01-01\nA Rao\n1 major, 2 minor\nSurveillance Audit 1\n2021-01-01\nTBD\nscheduled",
    "DOC-FS-2020": "FY2019-20\nA. REVENUE FROM OPERATIONS\nContract Revenue\n1,000\n900\nTotal Revenue from Operations\n(A)\n1,010\n905\nB. EXPENSES\nWages Paid\n500\n400\nProfit Before Tax\n510",
    "DOC-RABILL-1": "Bill No: AR-2020-1\nRunning Account Bill — RA 3\nContract #4 · Water Board\nDate: 31 Mar 2020\n1\nEarth work\ncum\n10\n5.5\n55\nValue of work done — this bill\n1,000\nAdd: GST @18%\n180\nLess: Retention @5%\n(50)\nNet claimed (before client TDS)\n1,130\nCumulative up to & incl. RA 3\n3,000",
    "DOC-FINBILL-1": "Contract #4 · Water Board · 2 RA bills\nAwarded Value\nINR 1 Cr\nRevised Value\nINR 1.2 Cr\nPeriod\n1 Jan 2020 — 31 Mar 2020\n1\nEarth work\ncum\n10\n5\n90,00,000\nTotal\n90,00,000\n1\nAR-2020-1\n2020-01-31\n40\n40\n2\nAR-2020-2\n2020-02-28\n50\n90\nend",
    "DOC-BANK-1": "FY 2020\nOpening balance b/f\n100\n2020-04-01\nFee\n30\n70\n2020-04-02\nSale\n80\n150\nend",
    "DOC-GLB-1": "FY 2020\nACCOUNT 10 — Bank (ASSET)\n2020-04-01\nOpening\n100\n100\nDr\n2020-04-02\nlong\nname\n50\n150\nDr\nACCOUNT 20 — Payables (LIABILITY)\n2020-04-01\nBill\n70\n70 Cr",
    "DOC-AR-2020": "FY 2020\n4 contracts remained in execution\nSEGMENT REVENUE\nSegment\n1\n2\nRoads\n100\n90\nPRINCIPAL CLIENTS\nWater Board\n55\nOrder inflow\nQ1 FY 2020-21\n25\nANNEXURE — ORDER BOOK\n1\nWater\nBoard\nitem-\nrate\n10\n5\n15\nactive\n2\nCity Metro\nepc\n20\n0\n20\nclosed\nANNEXURE — VARIATION ORDERS\n#4\n1\n05/06/2020\n-7\nscope\nCREDIT NOTES ISSUED\nCN-2020-1\n01/07/2020\n3\nrefund\nANNEXURE — TRADE",
    "DOC-AR-2021": "FY 2021\nSEGMENT REVENUE\nRoads\n120\n999\nDams\n7\n5\nPRINCIPAL CLIENTS",
    "DOC-CCC-1": "Project Name Canal Client Water Board (PSU) Work Category Irrigation Contract Value INR 3 Cr Completion Date 2020-05-01 Project Manager A Rao 2. defect liability period of 365 days from the date of completion (i.e., until 2021-05-01)",
    "DOC-CC-1": "a client's copy, not the contractor's",
    "DOC-PCERT-1": "This is to certify that\nA Rao\nCredential Type\nPMP\nCredential ID\nX1\nDate of Issue\n01/02/2020\nValid Through\n2021-02-01\nEmployee ID: E7",
    "DOC-CV-1": "Name\nA Rao\nDesignation\nLead\nTotal Experience\n12 years\nDate of Joining\n2026-03-01",
    "DOC-REF-1": "Water Board\nOur ref: R/1\nthe work “Canal” (INR 12,94,00,000/-) was completed on 3 May 2020, valid for a period of High",
    "DOC-DOSSIER-1": "Dossier Canal Works — Tender RFP-12\nBid value: INR 2 Cr\nEarnest money of INR 0\nNorth Unit\nmega\n40\nSouth Unit\nsme\n2\n2019-20\nINR 3 Cr\nINR 25000000\nRs. 4 Lakh\nend",
    "DOC-FS-NULL": None,
}


@pytest.fixture(scope="module")
def made(spark):
    return estate.tables(spark.createDataFrame(list(TEXTS.items()), "doc string, text string"))


def rows(df, *cols, order=None):
    return [tuple(r) for r in (df.orderBy(order) if order else df).select(*cols).collect()]


def test_every_table_runs(made, spark):
    empty = estate.tables(spark.createDataFrame([], "doc string, text string"))
    assert len(made) == 36
    for name, df in made.items():
        assert "Python" not in df._jdf.queryExecution().toString()
        assert df.columns == empty[name].columns
    for name in ("bond", "order_line", "segment", "bank_year"):
        assert empty[name].count() == 0


def test_records(made):
    d = dt.date
    assert rows(made["bond"], "bond_no", "amount", "work", "validity_days", "contract_value", "tender_ref") == [("BG/77-1", 15_000_000, "Canal Lining", 366, 300_000_000, "RFP-12")]
    assert rows(made["compliance"], "requirements", "complied", "not_complied", "bid_value", "work") == [(3, 1, 2, 20_000_000, "Canal Lining")]
    assert rows(made["iso_cert"], "cert_no", "standard", "body", "validity_days", "major_ncs", "minor_ncs", "audits_done") == [("Q-1", "ISO 9001:2015", "TUV", 1096, 1, 2, 1)]
    assert rows(made["ra_bill"], "ra", "contract", "client", "value_of_work", "gst", "gst_pct", "retention", "net_claimed", "cumulative", "year") == [(3, 4, "Water Board", 1000, 180, 18.0, 50, 1130, 3000, 2020)]
    assert rows(made["final_bill"], "contract", "ra_count", "awarded", "executed", "gap", "revised_gap", "period_days") == [(4, 2, 10_000_000, 9_000_000, 1_000_000, 3_000_000, 90)]
    assert rows(made["company_cert"], "work", "client", "client_type", "value", "completed", "defect_liability_days", "manager") == [("Canal", "Water Board", "PSU", 30_000_000, d(2020, 5, 1), 365, "A Rao")]
    assert rows(made["credential"], "name", "credential_type", "issued", "validity_days", "employee_id") == [("A Rao", "PMP", d(2020, 2, 1), 366, "E7")]
    assert rows(made["cv"], "name", "experience_years", "tenure_days") == [("A Rao", 12, 30)]
    assert rows(made["reference_letter"], "client", "work", "value", "completed", "validity") == [("Water Board", "Canal", 129_400_000, d(2020, 5, 3), "High")]
    assert rows(made["dossier"], "rfp_ref", "bid_value", "emd", "headcount", "work") == [("RFP-12", 20_000_000, 0, 42, "Canal")]


def test_listings(made):
    assert rows(made["fin_line"], "account", "section", "current", "previous", order="current") == [
        ("Wages Paid", "B. EXPENSES", 50_000_000, 40_000_000), ("Profit Before Tax", "B. EXPENSES", 51_000_000, None),
        ("Contract Revenue", "A. REVENUE FROM OPERATIONS", 100_000_000, 90_000_000), ("Total Revenue from Operations (A)", "A. REVENUE FROM OPERATIONS", 101_000_000, 90_500_000)]
    assert rows(made["bank_txn"], "particulars", "deposit", "withdrawal", "balance", order="balance") == [("Fee", None, 30, 70), ("Sale", 80, None, 150)]
    assert rows(made["bank_year"], "opening", "deposits", "withdrawals", "closing", "net_movement") == [(100, 80, 30, 150, 50)]
    assert rows(made["ledger_account"], "code", "account", "account_type", "closing", "closing_signed", "total", order="code") == [(10, "Bank", "Asset", 150, 150, 150), (20, "Payables", "Liability", 70, -70, 70)]
    assert rows(made["segment"], "segment", "year", "current", order=["segment", "year"]) == [("Dams", 2020, 5), ("Dams", 2021, 7), ("Roads", 2019, 90), ("Roads", 2020, 100), ("Roads", 2021, 120)]
    assert rows(made["ra_line"], "ra", "value", "cumulative", order="ra") == [(1, 40, 40), (2, 50, 90)]
    assert sorted(rows(made["boq_line"], "description", "amount")) == [("Earth work", 55), ("Earth work", 9_000_000)]
    assert rows(made["variation"], "contract", "value_delta", "reason") == [(4, -7, "scope")] and rows(made["credit_note"], "credit_note", "amount") == [("CN-2020-1", 3)]
    assert rows(made["quarter"], "quarter", "year", "net_revenue") == [("Q1", 2020, 25)] and rows(made["principal_client"], "client", "billings") == [("Water Board", 55)]
    assert rows(made["dossier_standing"], "year", "gross_billings", "net_turnover", "net_profit") == [(2019, 30_000_000, 25_000_000, 400_000)]


def test_order_lines_of_the_latest_report_only(spark):
    only = {k: v for k, v in TEXTS.items() if k == "DOC-AR-2020"}
    made = estate.order_line(spark.createDataFrame(list(only.items()), "doc string, text string"))
    assert rows(made, "seq", "client", "type", "awarded", "variations", "current_value", "status", order="seq") == [(1, "Water Board", "item-rate", 10, 5, 15, "active"), (2, "City Metro", "epc", 20, 0, 20, "closed")]


def table(spark, name, **texts):
    return estate.TABLES[name](spark.createDataFrame([(k.replace("_", "-"), v) for k, v in texts.items()], "doc string, text string"))


def test_long_annexures_lose_no_row(spark):
    notes = "\n".join(f"CN-2020-{k}\n01/07/2020\n{k}\nrefund no {k}" for k in range(600))
    made = table(spark, "credit_note", DOC_AR_2020=f"FY 2020\nCREDIT NOTES ISSUED\n{notes}\nANNEXURE — TRADE RECEIVABLES")
    assert made.count() == 600 and made.agg({"amount": "sum"}).first()[0] == sum(range(600))
    orders = "\n".join(f"{k}\nWater\nBoard {k}\nepc\n{k},000\n0\n{k},000\nactive" for k in range(1, 901))
    made = table(spark, "order_line", DOC_AR_2020=f"FY 2020\nANNEXURE — ORDER BOOK\n{orders}\nANNEXURE — VARIATION ORDERS")
    assert made.count() == 900 and rows(made.filter("seq = 900"), "client", "type", "awarded", "status") == [("Water Board 900", "epc", 900_000, "active")]


def test_statements_keep_rows_that_look_alike_and_their_order(spark):
    text = "FY 2020\nOpening balance b/f\n100\n2020-04-01\nFee\n10\n90\n2020-04-01\nFee\n10\n0\n80\n2020-04-01\nFee\n10\n70\n2020-04-01\nSale\n50\n120\n2020-04-02\nEnd\n0\n20\n140\nClosing"
    made = table(spark, "bank_txn", DOC_BANK_1=text)
    assert rows(made, "particulars", "deposit", "withdrawal", "balance", order=["date", "pos"]) == [
        ("Fee", None, 10, 90), ("Fee", 0, 10, 80), ("Fee", None, 10, 70), ("Sale", 50, None, 120), ("End", 20, 0, 140)]


def test_client_certificates_by_label_and_by_prose(spark):
    labels = "To whom it may concern\nName of Work\nCanal Lining – Kerala Pkg-7 (Irrigation)\nEmployer\nWater Board (PSU)\nNature of Work\nIrrigation\nExecuted Value\nINR 12.5 Cr\nDate of Completion\n3 May 2020\nProject Lead\nMr. A Rao\nThe work is graded as Very Good."
    prose = "City Metro\nThis is to say that the work of “Viaduct Pkg-9” was completed in all respects on 01/02/2019 at a gross executed value of Rs. 3 Crore, supervised at all times by Bela Sen."
    made = table(spark, "client_cert", DOC_CC_1=labels, DOC_CC_2=prose, DOC_CC_3="", DOC_CCC_1=labels)
    d = dt.date
    assert rows(made, "work", "work_key", "client", "category", "value", "completed", "lead", "grading", order="doc") == [
        ("Canal Lining – Kerala Pkg-7", "canal lining kerala pkg 7", "Water Board", "Irrigation", 125_000_000, d(2020, 5, 3), "A Rao", "Very Good"),
        ("Viaduct Pkg-9", "viaduct pkg 9", "City Metro", None, 30_000_000, d(2019, 2, 1), "Bela Sen", None),
        (None, None, None, None, None, None, None, None)]
    own = estate.certificate(spark.createDataFrame([("DOC-CC-2", prose)], "doc string, text string"), "client_cert", "City Metro")
    assert rows(own, "client") == [(None,)]


def test_portfolio_entries(spark):
    text = "Works\n1. Canal Lining – Kerala Pkg-7\nClient\nIrrigation and Waterways Dept, Govt of Kerala (JV\nPartner)\nCategory\nIrrigation\nExecuted Value\nINR 40.00 Cr\nCompleted\nDecember 8, 2012 - Certificate 1\n2. not a heading\n3. Bridge over a river Pkg-8\n\nClient\nRoads Board\nValue\n5 Lakh"
    made = table(spark, "portfolio", DOC_PORT_1=text, DOC_PORT_2="")
    assert rows(made, "seq", "work", "client", "role", "category", "value", "completed", order="seq") == [
        (1, "Canal Lining – Kerala Pkg-7", "Irrigation and Waterways Dept, Govt of Kerala", "JV Partner", "Irrigation", 400_000_000, dt.date(2012, 12, 8)),
        (3, "Bridge over a river Pkg-8", "Roads Board", None, None, 500_000, None)]


def test_credentials_by_layout(spark):
    made = table(spark, "credential", DOC_PCERT_1="PMI\n\nPMP\nThis credential is conferred upon\nBela Sen", DOC_PCERT_2="Credential Type\nsix sigma BLACK belt\nThis is to certify that\nA Rao", DOC_PCERT_3="for ASQ members")
    assert rows(made, "credential", "name", order="doc") == [("PMP", "Bela Sen"), ("Six Sigma Black Belt", "A Rao"), ("ASQ", None)]


def test_dossier_annexures(spark):
    text = ("Dossier Canal & Dam Works — Tender RFP-12\nThe Tender Inviting Authority,\nWater Board\nAnnexure\nContents\nA\nLetters\nB\nRegisters\nDOC-1\nAnnexure B — Registers\nTax office\nT-1\nactive\n"
            "Labour office\nL-2\nExpired\nCertificate Copy 1\nCertificate Copy 2\nAnnexure H — Bid security\nTender\nBank\nAmount\nValid To\nRFP-12\nState Union Bank\nINR 5 Lakh\n31 Mar 2021")  # fmt: skip
    made = table(spark, "dossier", DOC_DOSSIER_1=text)
    assert rows(made, "work", "client", "annexures", "registrations", "cert_copies", "bid_security_bank", "bid_security", "bid_security_valid_to") == [
        ("Canal & Dam", "Water Board", 2, 2, 2, "State Union Bank", 500_000, dt.date(2021, 3, 31))]


@pytest.mark.parametrize(("template", "text", "want"), [
    ("valid from {date} until {=date}", "is valid from 2020-01-01 until 1 Jan 2021.", "1 Jan 2021"), ("{=int} owned assets", "with 1,234 owned assets", "1,234"),
    ("Bond No {=code}", "BOND NO: BG/7-1.", "BG/7-1"), ("{=RFP-}", "see RFP-12, RFP-13", "RFP-12"), ("EMD Amount {money} ({=double}%)", "EMD Amount INR 2 Cr (2.5%)", "2.5"),
    ("a [b|] {=word}", "a b cd", "cd"), ("a [b|] {=word}", "a cd", "cd"), ("Value {=money}", "Revalue INR 2 Cr", None), ("by {=person}", "by the old A. Rao", None),
])
def test_templates(spark, template, text, want):
    from tessera.operators import forms

    row = forms.paged(spark.createDataFrame([(text,), (None,)], "text string")).select(forms.says(template)(forms.PAGE)).collect()
    assert [r[0] for r in row] == [want, None]


def test_printed_texts_are_read_on_all_cores(spark):
    """A small file of customers is one split; what is printed from it and read back is not one task."""
    from pyspark.sql import functions as F

    from tessera import catalog_text

    dealt = catalog_text._customers(spark, "/root/testdata/sf0.01")
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) >= spark.sparkContext.defaultParallelism and max(sizes) < sum(sizes) / 4


def passes_over_texts(df):
    """How often a finished query has read its texts: generators that ran, those behind a reused exchange not counted."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return len([line for line in plan.splitlines() if re.search(r"[-+ ]Generate (pos)?explode", line)])


def test_summaries_of_the_latest_report_are_read_once(spark):
    from tessera import catalog

    catalog.queries()
    for name in ("estate_seven_year", "estate_order_line"):
        assert passes_over_texts(catalog.QUERIES[name](spark, "/root/testdata/sf0.001")) == 1
    text = "FY {y}\nSEVEN-YEAR FINANCIAL SUMMARY\n2018-19\n{n}\n3\n-5\n2.5%\n2017-18\n4\n3\n-5\n1%\nANNEXURE"
    made = table(spark, "seven_year", DOC_AR_1=text.format(y=2020, n=7), DOC_AR_2=text.format(y=2021, n=8), DOC_AR_3=text.format(y=2021, n=8), DOC_AR_4="FY 2022\nnone", DOC_AR_5=text.format(y="x", n=9))
    assert sorted(rows(made, "year", "gross_billings", "margin")) == [(2017, 4, 1.0), (2017, 4, 1.0), (2018, 8, 2.5), (2018, 8, 2.5)]


def test_statements_of_both_layouts_are_read_once(spark):
    one = "FY 2020\nOpening balance b/f\n100\n2020-04-01\nFee\n10\n90\n2020-04-02\nSale\n50\n140\nend"
    two = "FY 2020\n2020-04-01\nFee\n10\n0\n80\n2020-04-02\nSale\n0\n20\n100\nend"
    made = table(spark, "bank_year", DOC_BANK_1=one, DOC_BANK_2=two, DOC_BANK_3=None, DOC_BANK_4="FY 2020")
    assert rows(made, "doc", "opening", "deposits", "withdrawals", "closing", "net_movement", order="doc") == [("DOC-BANK-1", 100, 50, 10, 140, 40), ("DOC-BANK-2", None, 20, 10, 100, 100)]
    assert passes_over_texts(made) == 1


def test_figures_make_what_is_asked_for(spark):
    """Readers look around numbers alone and make what is asked for; signs, units and other digits are read as before."""
    from pyspark.sql import functions as F

    from tessera.functions import norm

    said = ["Rs. 1,234/- net", "-5 lakh and 7", "(12)", "x-3", "\u0663", "a.b", "", None, "INR -2.5 Cr"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string").orderBy("i").select(norm.number(F.col("t")), norm.money(F.col("t")), norm.figures(F.col("t"), "value").alias("v")).collect()
    assert [(r[0], r[1]) for r in got] == [(1234, 1234), (-5, -500000), (-12, -12), (3, 3), (3, 3), (None, None), (None, None), (None, None), (-2, -25000000)]
    assert got[1]["v"][0].asDict().keys() == {"value"}
