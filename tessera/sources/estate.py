"""Typed tables from the texts of a document estate, as declarations.

A document type is its id prefix.  A *record* has one row per document: sentences with
typed holes and labels say where each column is printed.  A *listing* has one row per run of lines whose
cells have the types of its columns.  ``operators.forms`` reads both within the row of a
document, so a table is one pass over its type's texts and Catalyst prunes the columns
that nobody asks for.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import norm
from tessera.operators import extract
from tessera.operators.forms import (
    PAGE, Cell, Page, Reader, below, between, bound, cells, every, first, first_line, labelled, line_with, on_line, paged, parts, run_starts, runs, says, serial_parts, typed,
)

# What the documents print (id prefixes, labels, headings, statuses, units) and the day of the estate.
AS_AT = "2026-03-31"
LAKH = 100_000
TYPES = {
    "DOC-BOND-": "bond", "DOC-CM-": "compliance", "DOC-CERT-": "iso_cert", "DOC-DOSSIER-": "dossier", "DOC-FS-": "financials", "DOC-RABILL-": "ra_bill",
    "DOC-FINBILL-": "final_bill", "DOC-BANK-": "bank", "DOC-GLB-": "ledger", "DOC-AR-": "annual_report", "DOC-CCC-": "company_cert", "DOC-CC-": "client_cert",
    "DOC-CV-": "cv", "DOC-PCERT-": "credential", "DOC-REF-": "reference_letter", "DOC-PORT-": "portfolio",
}
COMPLIED, OPEN = ["complied", "met"], ["not complied", "partially complied", "not met", "n/a", "pending"]
SECTORS, ROLES, CONTRACT_TYPES = "[(Government)|(Private)|(PSU)]", ("Prime", "JV Partner", "Sub-contractor", "Subcontractor", "Consortium"), ("item-rate", "lump-sum", "epc")
ORDER_STATUSES, ACCOUNT_TYPES = ("active", "closed", "on hold", "suspended"), ("asset", "liability", "income", "expense", "equity", "revenue")
BOQ_UNITS = ("cum", "MT", "rmt", "sqm", "nos", "LS", "km", "kg", "t")
AUDITS = ("Initial Certification", "Surveillance Audit 1", "Surveillance Audit 2", "Surveillance Audit 3", "Re-certification")
OFFICES = ("Chief", "Executive", "Superintending", "Deputy", "Project", "Additional", "Assistant", "Senior")
LABELS = {
    "work": ("Work", "Project Name", "Name of Work", "Work Executed", "Project"), "client": ("Client", "Employer", "Client / Employer"),
    "category": ("Category", "Work Category", "Nature / Category", "Nature of Work"), "value": ("Executed Value", "Contract Value", "Contract Value (Original)", "Value"),
    "completed": ("Completion", "Completion Date", "Date of Completion", "Completed"), "lead": ("Project Lead", "Project Manager", "Contractor's Project Manager"),
    "certref": ("Client Certificate Ref", "Contract / Tender Reference"), "role": ("Contractor's Role", "Role"),
}
DASH = "[—|–|-]"

#: table: {column: (kind, where it is printed)}
RECORDS: dict[str, dict[str, tuple[str, Reader]]] = {
    "bond": {
        "bond_no": ("text", says("Bond No {=code}", "BG No {=code}", "Bond Reference {=code}")), "issue_date": ("date", says("Issue Date {=date}", "Date {=date}")),
        "bank": ("text", line_with("Bank")), "tender_ref": ("text", says("{=RFP-}")), "guarantee_pct": ("double", says("for {=double}% (")),
        "work": ("text", says("for the work of {=words} [Works|Work]~,", f"Performance Bond {DASH} {{=words}} [Works|Work] (", f"Subject: {{text}} {DASH} {{=words}} [Works,|Works (|Work,|,|(|Tender]")),
        "from_text": ("date", says("valid from {=date}")), "valid_until": ("date", says("valid from {date} until {=date}", "in force up to and including {=date}")),
        "stamp_value": ("money", says(f"Stamp Paper {DASH} Value {{=money}}", f"Stamp Paper {DASH} Value: {{=money}}")), "status": ("text", says("Bond Reference {code} Status {=word}")),
    },
    "compliance": {
        "tender_ref": ("text", says("{=RFP-}")), "work": ("text", says("Tender [Ref:|Ref|] {RFP-} [·|] {=words} [CM/|Bid Value]", "Tender [Ref:|Ref|] {RFP-} [·|] {=words} {int}")),
        "turnover_req": ("money", says("turnover requirement ({=money}", "Annual Turnover [>=|>|] {=money}")),
        "staff_min": ("int", says("key technical staff ({=int} minimum)", "Minimum {=int} site engineers")),
        "owned_assets": ("int", says("{=int} owned assets", "Asset register on record ({=int} items)")), "personnel": ("int", says("{=int} personnel on rolls", "{=int} engineers available")),
        "emd_ref": ("text", says("{=EMD-}")), "emd_amount": ("money", says("EMD Amount {=money}")), "emd_pct": ("double", says("EMD Amount {money} ({=double}%)")),
        "bid_value": ("money", says("Bid Value {=money}")), "submitted": ("date", says("Bid Submission Date {=date}")),
        "fy_from": ("int", says("FY~{=year} [–|-] [FY|]~{year}")), "fy_to": ("int", says("FY~{year} [–|-] [FY|]~{=year}")),
    },
    "iso_cert": {
        "cert_no": ("text", says("Certificate No {=code}")), "standard": ("text", says("conform to the requirements of {=text} SCOPE OF REGISTRATION", "{=standard}", kinds={"standard": r"ISO ?\d+(?::\d+)?"})),
        "body": ("text", below("Certification Body")), "initial_date": ("date", below("Initial Certification Date")), "valid_until": ("date", below("Valid Until")),
    },
    "dossier": {
        "work": ("text", says(f"dossier {{=words}} [Works|Work] {DASH} Tender {{RFP-}}")), "rfp_ref": ("text", says("{=RFP-}")), "bid_value": ("money", says("Bid value {=money}")),
        "submitted": ("date", on_line("Submitted: {=text}")), "emd": ("money", says("Earnest money of {=money}")), "relevant_works": ("int", says(f"Past performance {DASH} {{=int}} relevant works")),
        "client": ("text", below("The Tender Inviting Authority,")),
    },
    "ra_bill": {
        "bill_no": ("text", says("Bill No {=code}", "Bill No: {=code}")), "ra": ("int", says(f"Running Account Bill {DASH} RA {{=int}}")), "contract": ("int", says("Contract #{=int}")),
        "client": ("text", on_line("Contract #{int} · {=text}")), "date": ("date", on_line("Date: {=text}")), "value_of_work": ("number", below("Value of work done — this bill")),
        "gst_pct": ("double", says("Add: GST @{=double}%")), "gst": ("number", says("Add: GST @{double}% {=figure}")), "retention_pct": ("double", says("Less: Retention @{=double}%")),
        "retention": ("magnitude", says("Less: Retention @{double}% {=figure}")), "net_claimed": ("number", below("Net claimed (before client TDS)")),
        "cumulative": ("number", says("Cumulative up to & incl. RA {int} {=figure}")),
    },
    "final_bill": {
        "contract": ("int", says("Contract #{=int}")), "client": ("text", on_line("Contract #{int} · {=text} · {int} RA bills", "Contract #{int} · {=text}")), "ra_count": ("int", says("· {=int} RA bills")),
        "awarded": ("money", below("Awarded Value")), "billed_headline": ("money", below("Total Value of Work Billed")), "revised": ("money", below("Revised Value")),
        "variations": ("money", below("Approved Variations")), "period": ("text", below("Period")), "total": ("number", below("Total")),
    },
    "bank": {"year": ("int", says("FY~{=year}")), "opening": ("number", below("Opening balance b/f"))},
    "ledger": {"year": ("int", says("FY~{=year}"))},
    "financials": {"year": ("int", says("FY~{=year}[–|-]{int}"))},
    "company_cert": {
        "work": ("text", says("Project Name {=text} Client", "Work {=text} Client")), "client": ("text", says(f"Client {{=text}} {SECTORS}")),
        "client_type": ("text", says("Client {text} ({=sector})", kinds={"sector": "Government|Private|PSU"})),
        "category": ("text", says("Work Category {=text} Contract Value", "Category {=text} Executed Value")), "value": ("money", says("[Contract|Executed] Value {=money}")),
        "completed": ("date", says("Completion Date {=date}", "Completion {=date}")), "manager": ("text", says("Project Manager {=person}", "Project Lead {=person}")),
        "dlp_stated": ("int", says("defect liability period of {=int} days")),
        "defect_liability_until": ("date", says("days from the date of completion (i.e., until {=date})", "days from the date of completion (i.e. until {=date})", "Defect Liability Ends {=date}")),
    },
    "cv": {
        "name": ("text", below("Name")), "employee_id": ("text", below("Employee ID")), "designation": ("text", below("Designation")), "business_unit": ("text", below("Business Unit")),
        "total_experience": ("text", below("Total Experience")), "qualification": ("text", below("Qualification")), "joined": ("date", below("Date of Joining")), "wage_group": ("text", below("Wage Group")),
        "experience_years": ("leading int", below("Total Experience")),
    },
    "credential": {
        "credential_type": ("text", below("Credential Type", "Certificate Type")), "credential_id": ("text", below("Credential ID", "Certificate No.", "Certificate Number")),
        "issuing_authority": ("text", below("Issuing Authority")), "issued": ("date", below("Date of Issue", "Issued", "Issue Date")), "expires": ("date", below("Valid Through")),
        "employment_status": ("text", below("Employment Status")), "experience_years": ("leading int", below("Years of Experience")), "highest_qualification": ("text", below("Highest Qualification")),
        "name": ("text", below("This is to certify that", "This credential is conferred upon", "Credential Holder")), "employee_id": ("text", says("Employee ID {=code}", "Employee ID: {=code}")),
    },
    "reference_letter": {
        "our_ref": ("text", says("Our ref {=code}", "Our ref: {=code}")), "client": ("text", first_line()),
        "work": ("text", says("work~[“|\"|']~{=text}~[”|\"|']", "Work Executed {=text} Value", "Project Name {=text} Scope of Work")),
        "value": ("money", says("({=money}~[/-|]~)", "Value {=money}")), "completed": ("date", says("completed on {=date}", "Completed {=date}", "Date of Completion {=date}")),
        "validity": ("text", says("valid for a period of {=word}")), "letter_date": ("date", says("{=spelt date}")), "category": ("text", says("Nature of Work {=text} Contract Value")),
        "role": ("text", says("Contractor's Role {=role}", kinds={"role": "|".join(ROLES[:2])})),
        "contact": ("text", first(says("Contact for Verification: {=person}", "Contact for Verification {=person}", "Verification: {=person} ·"), lambda p: _signatory(p))),
    },
    "annual_report": {
        "year": ("int", says("FY~{=year}")), "contracts_in_execution": ("int", says("{=int} contracts remained in execution")), "order_book_awarded": ("money", says("aggregate awarded value of {=money}")),
        "variations_value": ("money", says("approved variations of {=money}")), "variation_orders": ("int", says("across {=int} variation orders")),
        "credit_notes": ("int", says("{=int} credit notes aggregating")), "credit_notes_value": ("money", says("credit notes aggregating {=money}")),
    },
}


def _signatory(p: Page) -> Column:
    """A name of two or three words over an office."""
    person, office = Cell("name", "text"), lambda x: F.substring_index(x, " ", 1).isin(*OFFICES)
    named = lambda x: F.regexp_like(x, F.lit(r"^\p{Lu}[\p{L}.]+( \p{Lu}[\p{L}.]+){1,2}$"))
    at = F.get(F.filter(run_starts(p.lines, (person, person)), lambda i: named(F.get(p.lines, i)) & office(F.get(p.lines, i + 1))), F.lit(0))
    return F.get(p.lines, at)


@dataclass(frozen=True)
class Listing:
    """Rows of one document type: cells, the part of the text that holds them, headings that look like rows, what each row carries along."""

    doc_type: str
    columns: tuple[Cell, ...]
    within: tuple[str, str | None] | None = None
    skip: tuple[str, ...] = ()
    carries: tuple[str, ...] = ()
    not_then: str | None = None


_BOQ = cells(item="serial", description="any", unit=BOQ_UNITS, rate="figure", quantity="quantity", amount="figure")
_MONEY_LINE = cells(line="text", amount="unbracketed")

LISTINGS: dict[str, Listing] = {
    "audit": Listing("iso_cert", cells(type=AUDITS, date="date", auditor="any", finding="any"), carries=("cert_no", "standard")),
    "business_unit": Listing("dossier", cells(unit="text", scale=("enterprise", "mega", "sme", "small", "medium"), headcount="serial")),
    "registration": Listing("dossier", cells(body="text", number="any", status=("active", "inactive", "expired")), ("Annexure B", "Certificate Copy")),
    "security": Listing("dossier", cells(ref="any", bank="text", amount="money", valid_to="date"), ("Annexure H", None)),
    "dossier_standing": Listing("dossier", cells(year="fiscal", gross_billings="money", net_turnover="money", net_profit="money"), carries=("rfp_ref",)),
    "ra_boq": Listing("ra_bill", _BOQ, carries=("contract", "client")),
    "final_boq": Listing("final_bill", _BOQ, carries=("contract", "client")),
    "ra_line": Listing("final_bill", cells(ra="serial", bill_no="prefix:AR-", date="date", value="figure", cumulative="figure"), carries=("contract", "client")),
    "bank_two": Listing("bank", cells(date="date", particulars="any", withdrawal="figure", deposit="figure", balance="figure"), carries=("year", "opening")),
    "bank_one": Listing("bank", cells(date="date", particulars="any", amount="figure", balance="figure"), carries=("year", "opening"), not_then="figure"),
    "director": Listing("annual_report", cells(name="text", designation="text", attended="share"), carries=("year",)),
    "ar_line": Listing("annual_report", cells(account="text", current="money", previous="money"), carries=("year",)),
    "segment": Listing("annual_report", cells(segment="text", current="figure", previous="figure"), ("SEGMENT REVENUE", "PRINCIPAL CLIENTS"), ("segment", "client"), ("year",)),
    "principal_client": Listing("annual_report", cells(client="text", billings="figure"), ("PRINCIPAL CLIENTS", "Order inflow"), ("client", "billings gross"), ("year",)),
    "seven_year": Listing("annual_report", cells(year_of="fiscal", gross_billings="figure", net_revenue="figure", profit="figure", margin="percent"), ("SEVEN-YEAR FINANCIAL SUMMARY", "ANNEXURE"), carries=("year",)),
    "ageing": Listing("annual_report", cells(client="text", lt6="figure", m6_12="figure", gt12="figure", total="figure"), ("TRADE RECEIVABLES AGEING", None), carries=("year",)),
    "ar_liabilities": Listing("annual_report", _MONEY_LINE, ("EQUITY AND LIABILITIES", "=ASSETS"), ("particulars",), ("year",)),
    "ar_assets": Listing("annual_report", _MONEY_LINE, ("=ASSETS", "STATEMENT OF PROFIT"), ("particulars",), ("year",)),
    "ar_pl": Listing("annual_report", _MONEY_LINE, ("STATEMENT OF PROFIT", "NOTES TO THE"), ("particulars",), ("year",)),
    "quarter": Listing("annual_report", cells(quarter_of="quarter", net_revenue="figure")),
    "variation": Listing("annual_report", cells(contract="contract", amendment="serial", date="date", value_delta="figure", reason="any"), ("ANNEXURE — VARIATION ORDERS", "CREDIT NOTES"), carries=("year",)),
    "credit_note": Listing("annual_report", cells(credit_note="prefix:CN-", date="date", amount="figure", reason="any"), ("CREDIT NOTES ISSUED", "ANNEXURE — TRADE"), carries=("year",)),
}


def of_type(texts: DataFrame, doc_type: str) -> DataFrame:
    """(doc, text, flat, lines, bare) of the documents of a type; the longest prefix decides."""
    return paged(texts.filter(extract.doc_type(F.col("doc"), TYPES) == doc_type).select("doc", F.coalesce("text", F.lit("")).alias("text")))


def _columns(doc_type: str, names: tuple[str, ...] | None = None) -> list[Column]:
    spec = RECORDS[doc_type]
    return [typed(spec[n][1](PAGE), spec[n][0]).alias(n) for n in (spec if names is None else names)]


def record(texts: DataFrame, doc_type: str, names: tuple[str, ...] | None = None) -> DataFrame:
    """One row per document of the type."""
    return of_type(texts, doc_type).select("doc", *_columns(doc_type, names))


def _runs(name: str) -> Column:
    """All rows of a listing in its document, as an array."""
    spec = LISTINGS[name]
    read = lambda lines: runs(lines, spec.columns, spec.not_then)
    return bound(between(PAGE.lines, *spec.within), read) if spec.within else read(PAGE.lines)


def listing(texts: DataFrame, name: str) -> DataFrame:
    """One row per run, with its place in the document and what its document says once."""
    spec = LISTINGS[name]
    found = _runs(name)
    rows = of_type(texts, spec.doc_type).select("doc", F.explode(found).alias("r"), *(_columns(spec.doc_type, spec.carries) if spec.carries else ()))
    out = rows.select("doc", "r.*", *spec.carries)
    if spec.skip:
        out = out.filter(~F.lower(spec.columns[0].name).isin(list(spec.skip)))
    return out


def bond(texts: DataFrame) -> DataFrame:
    """Guarantees; the largest stated amount counts, a stated zero stays zero."""
    amount = F.array_max(F.transform(every("not exceeding {=money}")(PAGE), norm.money)).alias("amount")
    rows = of_type(texts, "bond").select("doc", *_columns("bond"), amount).withColumn("valid_from", F.coalesce("from_text", "issue_date")).drop("from_text")
    return rows.withColumns({
        "validity_days": F.datediff("valid_until", "valid_from"), "year": F.year("issue_date"), "expiry_year": F.year("valid_until"),
        "contract_value": F.bround(F.try_divide(F.col("amount") * 100.0, F.nullif("guarantee_pct", F.lit(0.0))), 0).cast("bigint"),
    })


def compliance(texts: DataFrame) -> DataFrame:
    """Matrices; what is not complied with in full, applicable or pending counts as not complied."""
    rows = requirement(texts)
    met = F.lower("status").isin(COMPLIED)
    counts = rows.groupBy("doc").agg(
        F.count("*").cast("int").alias("requirements"), F.count_if(met).cast("int").alias("complied"), F.count_if(~met).cast("int").alias("not_complied"),
        F.array_sort(F.collect_list(F.struct("n", "status"))).alias("rows"),  # as many as one matrix prints
    )
    return record(texts, "compliance").join(counts, "doc", "left")


def requirement(texts: DataFrame) -> DataFrame:
    return extract.serial_rows(of_type(texts, "compliance"), COMPLIED + OPEN, "doc", "text")


def audit(texts: DataFrame) -> DataFrame:
    found = lambda what: typed(F.regexp_extract("finding", rf"(?i)(\d+)\s*{what}", 1), "int")
    status = F.when(F.lower("finding").contains("scheduled") | F.lower("finding").contains("tbd"), "scheduled").otherwise("completed")
    return listing(texts, "audit").withColumns({"major": found("major"), "minor": found("minor"), "status": status, "year": F.year("date")}).drop("finding")


def iso_cert(texts: DataFrame) -> DataFrame:
    done = audit(texts).groupBy("doc").agg(F.sum("major").alias("major_ncs"), F.sum("minor").alias("minor_ncs"), F.count_if(F.col("status") == "completed").alias("audits_done"))
    return record(texts, "iso_cert").withColumn("validity_days", F.datediff("valid_until", "initial_date")).join(done, "doc", "left").fillna(0, ["major_ncs", "minor_ncs", "audits_done"])


def dossier(texts: DataFrame) -> DataFrame:
    """Bid dossiers with what their annexures hold; the first row of the security's table counts."""
    stated = lambda n: F.nullif(n, F.lit(0))
    copies = F.size(F.filter(PAGE.lines, lambda x: F.contains(F.lower(x), F.lit("certificate copy"))))
    contents = F.filter(between(PAGE.lines, "=Contents", "DOC-"), lambda x: F.regexp_like(x, F.lit("^[A-Z]$")))
    heads = F.aggregate(F.transform(_runs("business_unit"), lambda r: r["headcount"]), F.lit(0), lambda a, b: a + b)
    return of_type(texts, "dossier").select(
        "doc", *_columns("dossier"), stated(copies).alias("cert_copies"), stated(F.size(contents)).alias("annexures"), F.coalesce(F.size(_runs("registration")), F.lit(0)).alias("registrations"),
        stated(heads).alias("headcount"), F.get(_runs("security"), F.lit(0)).alias("s"),
    ).withColumns({"bid_security_bank": F.col("s.bank"), "bid_security": F.col("s.amount"), "bid_security_valid_to": F.col("s.valid_to"), "tender_ref": F.col("rfp_ref")}).drop("s")


def business_unit(texts: DataFrame) -> DataFrame:
    first_seen = F.row_number().over(Window.partitionBy("unit").orderBy("doc", "pos"))
    return listing(texts, "business_unit").withColumn("r", first_seen).filter("r = 1").select("unit", "scale", "headcount")


def fin_line(texts: DataFrame) -> DataFrame:
    """Statement lines in rupees (printed in lakhs) with the section they stand under; the first line of a name counts."""
    joined = F.regexp_replace("text", r"\n\(([A-Z])\)\n", " ($1)\n")  # a letter in parentheses belongs to the line over it
    capitals = lambda x: (F.upper(x) == x) & F.regexp_like(x, F.lit(r"^[A-Z]{2}|^[A-Z]\. "))
    figure_at = lambda i: F.coalesce(F.regexp_like(F.get(PAGE.lines, i), F.lit(r"^\(?-?\d")), F.lit(False))
    heads = F.filter(F.transform(PAGE.lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda h: capitals(h["x"]) & ~figure_at(h["i"] + 1))

    def row(r: Column) -> Column:
        nearest = F.element_at(F.filter("heads", lambda h: h["i"] <= r["pos"]), -1)["x"]
        behind = F.get(PAGE.lines, r["pos"] + 2)
        previous = F.when(F.regexp_like(behind, F.lit(r"^-?[\d,]+$")), norm.number(behind))
        return F.struct(r["pos"].alias("pos"), F.regexp_replace(r["account"], ":$", "").alias("account"), nearest.alias("section"), (r["current"] * LAKH).alias("current"), (previous * LAKH).alias("previous"))

    docs = paged(of_type(texts, "financials").select("doc", joined.alias("text"))).withColumn("heads", heads)
    rows = docs.select("doc", F.explode(F.transform(runs(PAGE.lines, cells(account="text", current="figure")), row)).alias("r"), *_columns("financials"))
    rows = rows.select("doc", "r.*", "year").filter((F.length("account") >= 4) & ~F.lower("account").startswith("particulars"))
    first_seen = F.row_number().over(Window.partitionBy("doc", "account").orderBy("pos"))
    return rows.withColumn("r", first_seen).filter("r = 1").drop("r", "pos").withColumn("balance", F.col("current"))


def ra_bill(texts: DataFrame) -> DataFrame:
    return record(texts, "ra_bill").withColumn("year", F.year("date"))


def final_bill(texts: DataFrame) -> DataFrame:
    listed = F.aggregate(_runs("final_boq"), F.lit(None).cast("bigint"), lambda acc, r: F.coalesce(acc + r["amount"], r["amount"], acc))
    rows = of_type(texts, "final_bill").select("doc", *_columns("final_bill"), listed.alias("listed"))
    ends = F.split("period", r"\s*[—–]\s*| - ")
    return rows.withColumns({
        "executed": F.coalesce("total", "listed"), "period_from": norm.parse_date(F.get(ends, F.lit(0))), "period_to": norm.parse_date(F.get(ends, F.lit(1))),
    }).drop("total", "listed").withColumns({
        "gap": F.col("awarded") - F.col("executed"), "revised_gap": F.col("revised") - F.col("executed"), "period_days": F.datediff("period_to", "period_from"),
    })


def ra_line(texts: DataFrame) -> DataFrame:
    return listing(texts, "ra_line").withColumn("year", F.year("date"))


def boq_line(texts: DataFrame) -> DataFrame:
    return listing(texts, "final_boq").unionByName(listing(texts, "ra_boq"))


def bank_txn(texts: DataFrame) -> DataFrame:
    """Movements by date and place; where one figure is printed, the running balance tells its direction.

    A run with a third figure behind it is of the layout with two columns, so no row is read
    twice and rows that look alike all count; places number both layouts together.  Both are read in one pass over the texts.
    """
    columns = ("pos", "date", "particulars", "withdrawal", "deposit", "balance", "amount")

    def alike(name: str) -> Column:
        has = {"pos", *[c.name for c in LISTINGS[name].columns]}
        return F.transform(_runs(name), lambda r: F.struct(*[(r[c] if c in has else F.lit(None).cast("bigint")).alias(c) for c in columns]))

    carried = LISTINGS["bank_two"].carries
    rows = of_type(texts, "bank").select("doc", F.explode(F.concat(alike("bank_two"), alike("bank_one"))).alias("r"), *_columns("bank", carried))
    rows = rows.select("doc", *[f"r.{c}" for c in columns if c != "amount"], *carried, "r.amount")
    before = F.coalesce(F.lag("balance").over(Window.partitionBy("doc").orderBy("date", "pos")), "opening", F.lit(0))
    rose, printed = F.col("balance") > before, F.col("amount").isNull()
    return rows.withColumns({
        "deposit": F.when(printed, F.col("deposit")).when(rose, F.col("amount")), "withdrawal": F.when(printed, F.col("withdrawal")).when(~rose, F.col("amount")),
    }).withColumn("amount", F.coalesce("amount", F.nullif("deposit", F.lit(0)), "withdrawal"))


def bank_year(texts: DataFrame) -> DataFrame:
    sums = bank_txn(texts).groupBy("doc", "year", "opening").agg(F.coalesce(F.sum("deposit"), F.lit(0)).alias("deposits"), F.coalesce(F.sum("withdrawal"), F.lit(0)).alias("withdrawals"), F.max_by("balance", F.struct("date", "pos")).alias("closing"))
    return sums.withColumn("net_movement", F.col("closing") - F.coalesce("opening", F.lit(0)))


def ledger_line(texts: DataFrame) -> DataFrame:
    """Entries under their account; the side stands beside the balance or on a line of its own."""
    heading = lambda x, i: F.startswith(x, F.lit("ACCOUNT ")) & F.regexp_like(x, F.lit(r"\d"))
    accounts = of_type(texts, "ledger").select("doc", *_columns("ledger"), F.posexplode(parts(PAGE.lines, heading)).alias("block", "part"))
    title = F.get("part", F.lit(0))
    kind = F.lower(F.regexp_extract(title, r"\((\w+)\)\s*$", 1))
    known = kind.isin(*ACCOUNT_TYPES)
    name = F.regexp_replace(title, r"^ACCOUNT\s+\d+\s*[—–-]\s*", "")
    beside = F.flatten(F.transform("part", lambda x: F.when(F.regexp_like(x, F.lit(r"(?i)^\(?[\d,]+\)?\s+(dr|cr)$")), F.split(x, r"\s+")).otherwise(F.array(x))))
    entries = bound(beside, lambda part: parts(part, lambda x, i: (F.length(x) <= 20) & norm.parse_date(x).isNotNull()))
    rows = accounts.select(
        "doc", "year", "block", F.regexp_extract(title, r"(\d+)", 1).try_cast("int").alias("code"), norm.flat(F.when(known, F.regexp_replace(name, r"\s*\(\w+\)\s*$", "")).otherwise(name)).alias("account"),
        F.when(known, F.initcap(kind)).alias("account_type"), F.posexplode(entries).alias("pos", "e"),
    )
    side = F.array_position(F.transform("e", lambda x: F.lower(x).isin("dr", "cr")), True).cast("int")
    figure = lambda k: F.get("e", side - k)
    sound = (side >= 5) & F.regexp_like(figure(3), F.lit(r"^[\d,]+$")) & F.regexp_like(figure(2), F.lit(r"^[\d,]+$"))
    return rows.filter(sound).select(
        "doc", "year", "code", "account", "account_type", "block", "pos", norm.parse_date(F.get("e", F.lit(0))).alias("date"), norm.flat(F.array_join(F.slice("e", F.lit(2), side - 4), " ")).alias("narration"),
        norm.number(figure(3)).alias("amount"), norm.number(figure(2)).alias("balance"), F.initcap(figure(1)).alias("side"),
    )


def ledger_account(texts: DataFrame) -> DataFrame:
    """Closing is the last entry; a credit closing is negative where it is signed."""
    place = F.struct("block", "pos")
    sums = ledger_line(texts).groupBy("doc", "year", "code", "account", "account_type").agg(F.max_by("balance", place).alias("closing"), F.max_by("side", place).alias("side"), F.sum("amount").alias("total"))
    return sums.withColumn("closing_signed", F.when(F.col("side") == "Cr", -F.col("closing")).otherwise(F.col("closing")))


def company_cert(texts: DataFrame) -> DataFrame:
    rows = record(texts, "company_cert")
    return rows.withColumn("defect_liability_days", F.coalesce("dlp_stated", F.datediff("defect_liability_until", "completed"))).drop("dlp_stated")


def certificate(texts: DataFrame, doc_type: str, own: str | None = None) -> DataFrame:
    """One work, client, value and date a certificate: labels first, prose where they are missing; ``own``: a letterhead that is no client."""
    under = {c: below(*labels)(PAGE) for c, labels in LABELS.items()}
    work = F.coalesce(under["work"], says("the work of~[“|\"|']~{=text}~[”|\"|']", "for the work~[“|\"|']~{=text}~[”|\"|']")(PAGE))
    head = first_line("\n")(PAGE)
    letterhead = F.when(~F.contains(F.lower(head), F.lit(own.lower())), head) if own else head
    return of_type(texts, doc_type).select(
        "doc", norm.without_trailing_note(norm.flat(work)).alias("work"), norm.norm_work(norm.without_trailing_note(norm.flat(work))).alias("work_key"),
        norm.norm_client(F.coalesce(under["client"], letterhead)).alias("client"), typed(under["category"], "text").alias("category"),
        F.coalesce(norm.money(under["value"]), norm.money(says("[gross executed|executed|] value of {=money}")(PAGE))).alias("value"),
        F.coalesce(norm.parse_date(under["completed"]), norm.parse_date(says("completed in all respects on {=date}")(PAGE))).alias("completed"),
        norm.norm_person(F.coalesce(under["lead"], says("supervised {text} by {=person}", "supervised by {=person}")(PAGE))).alias("lead"), under["certref"].alias("certref"), norm.grading(F.col("text")).alias("grading"),
    )


def client_cert(texts: DataFrame) -> DataFrame:
    return certificate(texts, "client_cert")


def portfolio(texts: DataFrame) -> DataFrame:
    """Numbered entries: a heading with a client's label within two lines opens one; a role in parentheses behind the client is the role."""
    near = lambda i: (F.get(PAGE.lines, i + 1) == "Client") | F.coalesce(F.get(PAGE.lines, i + 2) == "Client", F.lit(False))
    heading = lambda x, i: F.regexp_like(x, F.lit(r"^\d{1,3}\.\s+\S.{5,}$")) & near(i)
    rows = of_type(texts, "portfolio").select("doc", F.explode(parts(PAGE.lines, heading)).alias("part"))
    title = F.get("part", F.lit(0))
    part = F.col("part")
    said = labelled(part, "Client")
    role = F.lower(F.regexp_extract(said, r"\(([^()]+)\)\s*$", 1))
    known = role.isin(*[r.lower() for r in ROLES])
    spelt = F.create_map(*[F.lit(v) for r in ROLES for v in (r.lower(), r)])
    work = norm.flat(F.regexp_replace(title, r"^\d+\.\s+", ""))
    return rows.select(
        "doc", F.regexp_extract(title, r"^(\d+)", 1).cast("int").alias("seq"), work.alias("work"), norm.norm_work(work).alias("work_key"),
        norm.norm_client(F.when(known, F.regexp_replace(said, r"\s*\([^()]+\)\s*$", "")).otherwise(said)).alias("client"), F.when(known, F.try_element_at(spelt, role)).alias("role"),
        labelled(part, "Category").alias("category"), norm.money(F.coalesce(labelled(part, "Executed Value"), labelled(part, "Value"))).alias("value"), norm.parse_date(labelled(part, "Completed")).alias("completed"),
    )


def cv(texts: DataFrame) -> DataFrame:
    return record(texts, "cv").withColumn("tenure_days", F.datediff(F.lit(AS_AT).cast("date"), "joined"))


def credential(texts: DataFrame) -> DataFrame:
    """Credentials under their common name: the label, else what is conferred over a name, else a known type anywhere, at last the authority."""
    known = {"type": "PMP|Six Sigma Black Belt|Six Sigma Green Belt|CSSBB|CQE", "body": "PMI|ASQ"}
    conferred = F.array_position(F.transform(PAGE.lines, lambda x: F.lower(x).startswith("this credential is conferred upon")), True).cast("int")
    over = F.when(conferred > 1, F.get(PAGE.lines, conferred - 2))
    over = F.when(F.regexp_like(over, F.lit(f"(?i)^(?:{known['type']})$")), over)
    label = RECORDS["credential"]["credential_type"][1](PAGE)
    name = norm.credential_name(F.coalesce(label, over, says("{=type}", kinds=known)(PAGE), says("{=body}", kinds=known)(PAGE)))
    rows = of_type(texts, "credential").select("doc", *_columns("credential"), name.alias("credential"))
    return rows.withColumn("validity_days", F.datediff("expires", "issued"))


def reference_letter(texts: DataFrame) -> DataFrame:
    return record(texts, "reference_letter").withColumn("year", F.year("completed"))


def dossier_standing(texts: DataFrame) -> DataFrame:
    return listing(texts, "dossier_standing").drop("pos")


def director(texts: DataFrame) -> DataFrame:
    rows = listing(texts, "director")
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy("year", "doc", "pos"))).filter("r = 1").select("name", "designation", "year")


def segment(texts: DataFrame) -> DataFrame:
    """A report's own year wins; the comparative of the next report only fills gaps."""
    rows = listing(texts, "segment")
    own = rows.select("segment", "year", "current", "previous", F.lit(0).alias("p"), "doc")
    earlier = rows.select("segment", (F.col("year") - 1).alias("year"), F.col("previous").alias("current"), F.lit(None).cast("bigint").alias("previous"), F.lit(1).alias("p"), "doc")
    ranked = own.unionByName(earlier).withColumn("r", F.row_number().over(Window.partitionBy("segment", "year").orderBy("p", F.desc("doc"))))
    return ranked.filter("r = 1").select("segment", "year", "current", "previous")


def _latest(rows: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(rows.agg(F.max("year").alias("year"))), "year")  # one row


def _latest_read(rows: DataFrame) -> DataFrame:
    """The same where reading the rows is dear.  They are dealt out once they are read and the year is taken from whole rows: both sides need
    the same columns of one exchange, so no text is read twice as long as all columns are asked for."""
    dealt = rows.filter("year is not null").repartition("doc")
    latest = dealt.agg(F.max(F.struct("year", *[c for c in rows.columns if c != "year"])).alias("r")).select("r.year")
    return dealt.join(F.broadcast(latest), "year")  # one row


def seven_year(texts: DataFrame) -> DataFrame:
    return _latest_read(listing(texts, "seven_year").drop("pos")).select(F.col("year_of").alias("year"), "gross_billings", "net_revenue", "profit", "margin")


def order_book(texts: DataFrame) -> DataFrame:
    return _latest(record(texts, "annual_report"))


def order_line(texts: DataFrame) -> DataFrame:
    """Contracts in force of the latest report: the next expected number opens a row; three figures follow a client and a type, which may wrap."""
    rows = of_type(texts, "annual_report").select("doc", *_columns("annual_report", ("year",)), F.posexplode(bound(between(PAGE.lines, "ANNEXURE — ORDER BOOK", "ANNEXURE — VARIATION"), serial_parts)).alias("pos", "cells"))
    figure = lambda x: F.regexp_like(x, F.lit(r"^-?[\d,]+$"))
    figures = F.filter("cells", figure)
    words = F.regexp_replace(F.array_join(F.filter("cells", lambda x: ~figure(x) & (x != "")), " "), r"-\s+", "-")
    # the type that stands last parts the client from the status
    places = F.array(*[F.struct((F.length(words) - F.locate(t[::-1], F.lower(F.reverse(words))) - len(t) + 1).alias("at"), F.lit(t).alias("type")) for t in CONTRACT_TYPES])
    found = F.array_max(F.filter(places, lambda x: F.contains(F.lower(words), x["type"])))
    behind = F.lower(F.trim(F.substr(words, found["at"] + F.length(found["type"]) + 1)))
    out = rows.filter(F.size(figures) >= 3).select(
        "doc", (F.col("pos") + 1).alias("seq"), F.coalesce(F.nullif(F.trim(F.left(words, found["at"])), F.lit("")), F.when(found.isNull(), words)).alias("client"), found["type"].alias("type"),
        *[norm.number(F.get(figures, F.lit(i))).alias(c) for i, c in enumerate(("awarded", "variations", "current_value"))], F.when(behind.isin(*ORDER_STATUSES), behind).alias("status"), "year",
    )
    return _latest_read(out)


def ar_balance(texts: DataFrame) -> DataFrame:
    sections = (("ar_liabilities", "Equity and Liabilities"), ("ar_assets", "Assets"))
    two = [listing(texts, n).withColumn("section", F.lit(s)) for n, s in sections]
    return two[0].unionByName(two[1])


def quarter(texts: DataFrame) -> DataFrame:
    rows = listing(texts, "quarter")
    return rows.select("doc", F.left("quarter_of", F.lit(2)).alias("quarter"), F.regexp_extract("quarter_of", r"(\d{4})", 1).cast("int").alias("year"), "net_revenue")


def _listed(name: str) -> Callable[[DataFrame], DataFrame]:
    return lambda texts: listing(texts, name)


#: entity table: how it is made from (doc, text)
TABLES: dict[str, Callable[[DataFrame], DataFrame]] = {
    f.__name__: f
    for f in (bond, compliance, requirement, iso_cert, audit, dossier, business_unit, fin_line, ra_bill, final_bill, ra_line, boq_line, bank_txn, bank_year, ledger_line, ledger_account,
              company_cert, client_cert, portfolio, cv, credential, reference_letter, dossier_standing, director, segment, seven_year, order_book, order_line, ar_balance, quarter)
} | {name: _listed(name) for name in ("ageing", "principal_client", "ar_pl", "variation", "credit_note", "ar_line")}


def tables(texts: DataFrame) -> dict[str, DataFrame]:
    """All entity tables of a corpus (doc, text), lazily."""
    return {name: fn(texts) for name, fn in TABLES.items()}
