"""What words mean: entities, their measures and what names a row, as data.

A measure's cues are phrases; the first whose phrase stands in the question is meant, longer
phrases before shorter ones.  Columns without a cue are found by their own name.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from .quantities import BELIEFS


@dataclass(frozen=True)
class Entity:
    words: tuple[str, ...]  # phrases that name the table
    default: str | None  # measure without any cue
    cues: dict[str, tuple[str, ...]] = field(default_factory=dict)  # measure: phrases
    categories: tuple[str, ...] = ()  # columns whose values filter
    date: str | None = None  # column that orders rows in time
    name: str | None = None  # column that names a row
    planned: bool = True  # reachable by the planner; else only by shapes
    yearly: bool = True
    dates: dict[str, tuple[str, ...]] = field(default_factory=dict)  # other dates: the verbs that name them


STATED = {"emd_pct", "guarantee_pct", "margin", "retention_pct", "gst_pct", "turnover_req", "staff_min", "stamp_value"}  # a figure that isn't summed over rows
COUNTS = {"requirements", "complied", "not_complied", "major", "minor", "major_ncs", "minor_ncs", "audits_done", "headcount", "ra_count", "works_led", "cert_copies", "annexures",
          "registrations", "relevant_works", "credit_notes", "variation_orders", "contracts_in_execution", "owned_assets", "personnel"}

EXPIRES = {"valid_until": ("expire", "expires", "expiring", "expired", "expiry", "lapse", "lapses", "lapsed", "run out", "runs out", "valid until")}
ENTITIES: dict[str, Entity] = {
    "dossier_standing": Entity(("financial standing", "standing annexure"), "net_profit", {"gross_billings": ("gross billings",), "net_turnover": ("net turnover", "turnover"), "net_profit": ("net profit", "profit")}),
    "seven_year": Entity(("seven year summary", "seven-year"), "net_revenue", {"gross_billings": ("gross billings",), "margin": ("margin",), "profit": ("profit",), "net_revenue": ("net revenue", "revenue")}),
    "principal_client": Entity(("principal client", "principal clients"), "billings", {"billings": ("billings",)}, ("client",)),
    "order_line": Entity(("order book line", "contracts in force", "order-book contract"), "current_value", {"variations": ("variations",), "awarded": ("awarded",), "current_value": ("current value",)}, ("client", "type", "status")),
    "order_book": Entity(("order book",), "contracts_in_execution", {"credit_notes": ("credit notes",), "variation_orders": ("variation orders",), "order_book_awarded": ("awarded value", "awarded"), "contracts_in_execution": ("contracts",)}),
    "credit_note": Entity(("credit note", "credit notes"), "amount", date="date", name="credit_note"),
    "variation": Entity(("variation", "variations", "amendment", "amendments"), "value_delta", date="date", name="contract"),
    "segment": Entity(("segment", "segments"), "current", {"previous": ("previous year", "prior year"), "current": ("revenue",)}, ("segment",), name="segment"),
    "quarter": Entity(("quarter", "quarterly"), "net_revenue", {"net_revenue": ("net revenue", "revenue")}, ("quarter",), name="quarter"),
    "ageing": Entity(("ageing", "aging", "overdue"), "total", {"gt12": ("over twelve months", "more than 12 months", "beyond 12 months"), "m6_12": ("six to twelve months", "6 to 12 months"), "lt6": ("under six months", "less than 6 months"), "total": ("total",)}, ("client",)),
    "ar_pl": Entity(("statement of profit", "profit and loss"), "amount", categories=("line",)),
    "ar_balance": Entity(("balance sheet of the annual report", "annual report balance sheet"), "amount", categories=("line", "section")),
    "ar_line": Entity(("highlights", "annual report line"), "current", {"previous": ("previous year", "prior year"), "current": ("current",)}, ("account",)),
    "director": Entity(("director", "directors", "board member"), None, categories=("designation",), name="name"),
    "fin_line": Entity(("financial statement", "financial statements", "statement line"), "current", {"previous": ("previous year", "prior year"), "current": ("current year",)}, ("account", "section"), name="account"),
    "account": Entity(("trial balance",), "balance", {"debit": ("debit", "debits"), "credit": ("credit", "credits"), "balance": ("balance",)}, ("account", "year"), name="account", yearly=False),
    "ledger_line": Entity(("ledger entry", "ledger entries", "journal", "ledger postings"), "amount", {"balance": ("balance",), "amount": ("amount",)}, ("account", "side"), date="date"),
    "ledger_account": Entity(("ledger", "ledgers", "ledger account"), "closing", {"closing_signed": ("signed closing",), "total": ("total posted", "turnover"), "closing": ("closing",)}, ("account", "account_type", "side"), name="account"),
    "bank_year": Entity(("bank year", "bank statement", "bank statements"), "closing", {"net_movement": ("net movement",), "opening": ("opening",), "deposits": ("deposits",), "withdrawals": ("withdrawals",), "closing": ("closing",)}),
    "bank_txn": Entity(("bank transaction", "bank transactions", "bank movements", "account movements", "movements"), "deposit", {"withdrawal": ("withdrawal", "withdrawals", "withdrawn", "debited"), "deposit": ("deposit", "deposits", "deposited", "credited"), "balance": ("balance",), "amount": ("amount",)}, date="date"),
    "ra_line": Entity(("register of bills", "bill register"), "value", {"cumulative": ("cumulative",), "value": ("value",)}, ("client",), date="date", name="bill_no"),
    "ra_bill": Entity(("ra bill", "ra bills", "running account bill", "running account bills"), "net_claimed", {
        "retention_pct": ("retention percent", "retention rate"), "gst_pct": ("gst rate", "gst percent"), "gst": ("gst",), "retention": ("retention",), "cumulative": ("cumulative",), "value_of_work": ("value of work",), "net_claimed": ("net claimed", "claimed")}, ("client",), date="date", name="bill_no"),
    "final_bill": Entity(("final bill", "final bills"), "gap", {
        "period_days": ("period", "how many days"), "ra_count": ("number of ra bills",), "revised_gap": ("revised gap",), "revised": ("revised",), "variations": ("variations",), "awarded": ("awarded",), "executed": ("executed",), "gap": ("gap",)}, ("client",)),
    "measurement": Entity(("measurement", "measurements", "measured"), "amount", {"qty": ("quantity",), "amount": ("amount", "value")}, ("description",), date="measured_on"),
    "boq_line": Entity(("boq line", "boq lines", "bill of quantities line"), "amount", {"quantity": ("quantity",), "rate": ("rate",), "amount": ("amount", "value")}, ("description", "unit")),
    "boq_item": Entity(("boq", "bill of quantities"), "amount", {"quantity": ("quantity",), "rate": ("rate",), "amount": ("amount", "value")}, ("description", "unit")),
    "bond": Entity(("bond", "bonds", "guarantee", "guarantees"), "amount", {
        "contract_value": ("contract value",), "validity_days": ("validity", "how many days", "days"), "stamp_value": ("stamp",), "guarantee_pct": ("percent", "percentage"), "amount": ("amount", "value")}, ("bank", "work", "status"), date="issue_date", name="bond_no", dates=EXPIRES),
    "compliance": Entity(("compliance", "eligibility", "emd", "earnest money", "tender requirements"), "complied", {
        "emd_pct": ("emd percent", "emd percentage"), "not_complied": ("not complied", "not met", "unmet"), "turnover_req": ("turnover requirement",), "personnel": ("personnel",), "staff_min": ("staff",), "owned_assets": ("owned assets",),
        "emd_amount": ("emd amount", "earnest money", "emd"), "bid_value": ("bid value",), "complied": ("complied", "met"), "requirements": ("requirements",)}, ("work",), date="submitted", name="tender_ref"),
    "audit": Entity(("audit", "audits"), "minor", {"major": ("major",), "minor": ("minor",)}, ("auditor", "type", "standard"), date="date"),
    "iso_cert": Entity(("iso certificate", "iso certificates", "iso certification", "management standard", "certification body", "certification bodies"), "validity_days", {"major_ncs": ("major",), "minor_ncs": ("minor",), "validity_days": ("validity", "days")}, ("body", "standard"), date="initial_date", dates=EXPIRES),
    "business_unit": Entity(("business unit", "business units"), "headcount", {"headcount": ("headcount", "people", "staff")}, ("unit", "scale"), name="unit", yearly=False),
    "dossier": Entity(("dossier", "dossiers", "tender dossier"), "bid_value", {
        "bid_security": ("bid security",), "cert_copies": ("certificate copies",), "registrations": ("registrations",), "annexures": ("annexures",), "emd": ("earnest money", "emd"), "headcount": ("headcount",), "relevant_works": ("relevant works",), "bid_value": ("bid value",)}, ("work", "client")),
    "reference_letter": Entity(("reference letter", "reference letters", "letters of reference"), "value", {"value": ("value", "worth")}, ("client", "validity", "category", "role"), date="completed", name="work"),
    "company_cert": Entity(("completion certificate", "completion certificates", "company certificate", "defect liability"), "value", {"defect_liability_days": ("defect liability", "days"), "value": ("value", "worth")}, ("client", "category"), date="completed", name="work"),
    "cv": Entity(("cv", "cvs", "curriculum vitae", "employees", "staff members"), "tenure_days", {"wage_group": ("wage group",), "experience_years": ("experience", "years of experience"), "tenure_days": ("tenure", "days")}, ("qualification", "designation", "business_unit"), date="joined", name="name"),
    "credential": Entity(("credential", "credentials", "professional certificate", "professional certificates"), "validity_days", {"experience_years": ("experience",), "validity_days": ("validity", "days")}, ("credential", "issuing_authority"), date="issued", name="name"),
    "invoice": Entity(("invoice", "invoices", "billed", "bills", "invoiced", "received", "outstanding"), "invoiced", {
        "outstanding": ("outstanding", "owed", "unpaid"), "received": ("received", "collected"), "invoiced": ("invoiced", "billed")}, ("client", "status"), date="date", name="invoice_no"),
    "asset": Entity(("asset", "assets", "equipment", "machines", "plant register"), "cost", {"cost": ("cost", "worth", "value")}, ("make", "type", "location", "ownership", "condition"), name="asset_id", yearly=False),
    "person": Entity(("person", "people", "leads", "managers"), "value_led", {"value_led": ("value",), "works_led": ("works",)}, name="name", planned=False, yearly=False),
    "work": Entity(("work", "works", "project", "projects", "contract", "contracts", "portfolio", "assignment", "assignments"), "value", {"value": ("value", "worth", "size", "amount")}, ("client", "category", "state", "role", "grading", "client_type"), date="completed", name="work"),
}

#: Patterns of reductions; the first that fits is meant.
FUNCTIONS = [
    (r"\bmedian\b", "median"), (r"\b(?:average|mean|typical)\b", "mean"), (r"\b(?:largest|biggest|highest|maximum|(?<!at )most)\b", "max"),
    (r"\b(?:smallest|lowest|(?<!at )least|minimum|fewest)\b", "min"), (r"\b(?:how many|number of|count)\b", "count"), (r"\b(?:total|sum|altogether|combined|in all|how much)\b", "sum"),
]

#: Words of questions that single typing errors are corrected to.
PIVOTS = ("average", "median", "total", "value", "largest", "smallest", "highest", "lowest", "difference", "completed", "outstanding", "invoiced", "received", "reference",
          "without", "excluding", "between", "percentage", "proportion", "category", "categories", "project", "projects", "works", "credential", "portfolio", "number", "amount",
          "awarded", "billed", "shortfall", "threshold", "graded", "client", "letters", "invoices")

#: Phrases by what they signal.
SIGNALS: dict[str, tuple[str, ...]] = {
    "median": ("median",), "mean": ("average", "mean", "typical"), "exclude": ("excluding", "exclude", "except", "other than", "apart from", "leaving out", "leave out", "not counting", "barring", "setting aside"),
    "toward": ("shortfall", "short of", "fall short", "to reach", "needed to", "still needed", "away from", "how far", "remaining to", "gap to"),
    "awarded": ("awarded", "award value", "contract value", "executed value", "project value", "value of works", "works value", "completed value"), "billed": ("billed", "invoiced", "invoices", "billing"),
    "received": ("received", "collected", "paid", "receipts", "payments"), "owed": ("outstanding", "owed", "owe", "owes", "unpaid", "still due", "yet to be paid", "receivable", "receivables"),
    "against": ("against", "versus", "vs", "minus", "less", "compared with", "compared to", "exceed", "exceeds", "difference", "gap", "between"),
    "bar": ("above", "over", "at least", "more than", "crossing", "exceeding", "or more", "crosses", "upwards of", "not below", "minimum of"), "top two": ("two largest", "top two", "two biggest", "second largest", "second biggest", "runner-up", "next largest", "next biggest"),
    "done": ("completed", "complete", "finished", "delivered", "handed over", "executed", "completion"), "extreme": ("largest", "biggest", "highest", "smallest", "lowest", "single"), "gap": ("gap", "difference", "exceed", "ahead of", "lead over"),
    "letter": ("reference letter", "reference letters", "reference", "references", "letter", "letters", "referenced", "testimonial", "testimonials"), "lack": ("no reference", "without", "lack", "lacks", "lacking", "missing", "unreferenced", "have no", "has no", "not have", "absent"),
    "distinct": ("different", "distinct", "kinds of", "types of", "unique"), "grade": ("graded", "grading", "grade", "rated", "assessed"), "after": ("after", "since", "following", "once"),
    "whole": ("all clients", "every client", "across clients", "overall", "entire portfolio", "whole estate", "company-wide", "across the board"), "pay": ("received", "collected", "paid", "collection", "recovered", "invoiced", "billed"),
    "sum": ("total", "sum", "altogether", "combined", "in all", "aggregate", "how much"), "value": ("value", "worth", "amount", "total", "sum", "how much"), "believed": BELIEFS,
    "nonzero": ("non-zero", "nonzero", "positive", "any"), "zero": ("nil", "zero", "no"), "sign": ("positive if", "negative if", "as a positive", "as a negative", "sign"),
    "latest": ("latest", "most recent", "last"), "earliest": ("earliest", "oldest", "first"), "span": ("between the first and the last", "between first and last", "span of dates", "spread of dates", "first to the last"),
    "change": ("change", "changed", "differ", "difference", "grow", "grew", "growth", "rise", "rose", "fall", "fell"), "share": ("share", "proportion", "percent", "per cent", "percentage", "fraction"),
    "count column": ("how many", "number of", "count of", "total number"),
}
#: Documents that no shape reads: a question that names one goes to the planner.
DOCUMENTS = tuple(e for e, x in ENTITIES.items() if e not in ("work", "invoice", "person", "reference_letter", "credential", "variation", "measurement", "segment", "quarter", "ra_line"))
