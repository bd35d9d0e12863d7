"""Registered queries over texts: scalar functions, estate tables, resolution, plans from questions, and checks.

The texts are printed from the columns of a table, so that the SQL beside a query states
what must be read from them without reading any text.
"""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import _CREDENTIAL, _INVOICE, _LED, _WORK, register
from tessera.functions import norm
from tessera.operators import algebra, extract, hot, resolve, shapes, store, verify
from tessera.plans import bind, rewording, rewrite
from tessera.plans.answer import answer_all
from tessera.plans.compile import Vocabulary, compile_question
from tessera.plans.index import ValueIndex, word_list
from tessera.plans.ir import QueryPlan
from tessera.plans.mine import Known
from tessera.sources import estate, readers
from tessera.sources.work import spread

_C = """c AS (
  SELECT CAST(c_custkey AS BIGINT) AS k, c_name AS name, abs(CAST(round(c_acctbal * 100) AS BIGINT)) + 1000 AS n, n_name AS nation, c_mktsegment AS seg,
         CAST(DATE '2015-01-01' + CAST(c_custkey % 3000 AS INTEGER) AS DATE) AS day FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their nation, dealt out by key: what is printed from them and read back costs far more than the rows' few bytes say."""
    nations = F.broadcast(bind.table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("nation")))  # 25 rows
    rows = bind.table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return spread(rows.select(
        F.col("c_custkey").cast("bigint").alias("k"), F.col("c_name").alias("name"), (F.abs(bind.cents(F.col("c_acctbal"))) + 1000).alias("n"), "nation", F.col("c_mktsegment").alias("seg"),
        F.date_add(F.lit("2015-01-01").cast("date"), (F.col("c_custkey") % 3000).cast("int")).alias("day"),
    ), "k")


def _print(template: str, **more: Column) -> Column:
    """A text with {column} filled in."""
    cells = [F.lit(part) if i % 2 == 0 else more.get(part, F.col(part) if part not in more else None).cast("string") for i, part in enumerate(re.split(r"\{(\w+)\}", template))]
    return F.concat(*cells)


# ------------------------------------------------------------------ scalar functions


def scalar(name: str, template: str | list[str], fn, sql: str, *, column: str = "answer", columns: tuple[str, ...] = ("k",), **more) -> None:
    """One function over printed texts; several templates take turns by key."""
    forms = [template] if isinstance(template, str) else template

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = F.lit(None).cast("string")
        for i, form in enumerate(forms):
            text = F.when(F.col("k") % len(forms) == i, _print(form, **{c: make() for c, make in more.items()})).otherwise(text)
        return _customers(spark, sf_dir).withColumn("t", text).select(*columns, fn(F.col("t")).alias(column))

    register(name, f"SELECT {', '.join(columns)}, {sql} AS {column} FROM c", _C)(query)


def _turns(*expressions: str) -> str:
    return f"CASE k % {len(expressions)} " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(expressions)) + " END"


_GROUPED = {"grouped": lambda: F.format_number("n", 0)}
scalar("norm_money", ["INR {n} Cr", "Rs. {grouped}/-", "({n})", "-{n} Lacs", "INR -{n}", "{n}.5 crore", "no figure", "₹{n} lac", "net {grouped} only"], norm.money,
       f"CAST({_turns('n * 10000000', 'n', '-n', '-n * 100000', '-n', 'n * 10000000 + 5000000', 'NULL', 'n * 100000', 'n')} AS BIGINT)", **_GROUPED)
scalar("norm_threshold", ["crossing the seventy-three crore mark", "target of INR {n} Cr", "of {big} or more", "five lacs", "in 2020", "above two hundred lakh", "two and a half crore", "two hundred and five lakh or {big}"], norm.threshold,
       f"CAST({_turns('730000000', 'n * 10000000', 'n * 1000000', '500000', 'NULL', '20000000', 'NULL', '20500000')} AS BIGINT)", big=lambda: F.format_number(F.col("n") * 1_000_000, 0))
scalar("norm_words", ["seventy-three of {n}", "two hundred five", "nothing", "ninety"], norm.words_to_number, f"CAST({_turns('73', '205', 'NULL', '90')} AS INTEGER)")
scalar("norm_number", ["({grouped})", "{grouped}", "-{n}", "x"], norm.number, f"CAST({_turns('-n', 'n', '-n', 'NULL')} AS BIGINT)", **_GROUPED)
scalar("norm_date", ["{day}", "on {slashed}", "{spelt}", "{american} it was", "soon", "31/02/2020"], norm.parse_date, _turns("day", "day", "day", "day", "NULL", "NULL"),
       slashed=lambda: F.date_format("day", "dd/MM/yyyy"), spelt=lambda: F.date_format("day", "d MMM yyyy"), american=lambda: F.date_format("day", "MMMM d, yyyy"))
scalar("norm_iso", "on {day}", lambda t: norm.iso(norm.parse_date(t)), "CAST(day AS VARCHAR)")
scalar("norm_lenient_year", ["{day}T00", "x"], norm.lenient_year, _turns("CAST(year(day) AS INTEGER)", "NULL"))
scalar("norm_lenient_date", ["{day}T00", "2020-13-01"], norm.lenient_date, _turns("day", "NULL"))
scalar("norm_flat", "  {name} \n\t of  {nation} ", norm.flat, "name || ' of ' || nation")
scalar("norm_client", [" {name}  (PSU) ", "{name}.", "{name} (Government)", "{name} (Semi-Govt)", "{name} (Publications Board)", "({name})"], norm.norm_client, _turns("name", "name", "name", "name", "name || ' (Publications Board)'", "'(' || name || ')'"))
scalar("norm_person", ["Dr. {name}", "Shri {name}", "{name}", "Mr. {name} B.", "MS  {name},", "Drew {name}"], norm.norm_person, _turns("name", "name", "name", "name || ' B'", "name", "'Drew ' || name"))
scalar("norm_grading", ["is graded as Very\nGood.", "graded Good", "We assessed the completed work as Fair", "found satisfactory", "graded as {seg}"], norm.grading, _turns("'Very Good'", "'Good'", "'Fair'", "NULL", "NULL"))
scalar("norm_fiscal_label", "for the year ended 31 March {year}", norm.fiscal_label, "'FY' || (year(day) - 1) || '-' || lpad(CAST(year(day) % 100 AS VARCHAR), 2, '0')", year=lambda: F.year("day"))
scalar("norm_fiscal_years", "{name} as at 31st March, {year} and the year ended 31 March 2020", norm.fiscal_years,
       "name || ' FY' || (year(day) - 1) || '-' || lpad(CAST(year(day) % 100 AS VARCHAR), 2, '0') || ' and FY2019-20'", year=lambda: F.year("day"))
scalar("norm_mask_standards", "{name} by ISO 9001:2015 and OHSAS 18001 of {nation}", norm.mask_standards, "name || ' by ' || repeat(' ', 13) || ' and ' || repeat(' ', 11) || ' of ' || nation")
scalar("norm_mask_refs", "{name}: BOARD/{k}/003 of 28/08/2022", norm.mask_refs, "name || ': ' || repeat(' ', 10 + length(CAST(k AS VARCHAR))) || ' of 28/08/2022'")
scalar("norm_mask_epoch", "{name} days after {day} in 2020", norm.mask_epoch, "name || ' ' || repeat(' ', 21) || ' in 2020'")
scalar("norm_after_label", ["x\nEmployer:\n  {name} \ny", "Employer {name}"], lambda t: norm.after_label(t, "Employer"), _turns("name", "NULL"))
scalar("norm_clean_work", ["{name} (old)", "{name} (Pkg-{k})"], norm.without_trailing_note, _turns("name", "name || ' (Pkg-' || k || ')'"))
scalar("norm_credential", ["pmp", "SIX SIGMA  black belt", "CSSBB", "{seg}  {seg}", " ", "{nation}"], norm.credential_name,
       _turns("'PMP'", "'Six Sigma Black Belt'", "'Six Sigma Black Belt'", "upper(seg[1]) || lower(seg[2:]) || ' ' || upper(seg[1]) || lower(seg[2:])", "NULL", "upper(nation[1]) || lower(nation[2:])"))
scalar("norm_section", ["head <A>{name}<B> tail <B>", "{name}", "<A>{nation}"], lambda t: norm.section(t, "<A>", "<B>"), _turns("name", "NULL", "nation"))
scalar("norm_state", "Canal – {nation} Pkg-{k}", norm.state_of, "nation")
scalar("norm_folded", ["UP PWD & {name}", "pulling up {nation}", "the up irrigation file"], lambda t: norm.folded(t, {"pwd": "public works department"}, capital={"UP": "uttar pradesh"}, beside=["irrigation"]),
       _turns("'uttar pradesh public works department and ' || replace(lower(name), '#', ' ')", "'pulling up ' || replace(lower(nation), '_', ' ')", "'the uttar pradesh irrigation file'"))
scalar("norm_negated_states", ["{name} of kerala not goa", "not the Goa or Kerala one, goa"], lambda t: norm.without_negated(t, ["goa", "kerala"]), _turns("name || ' of kerala not'", "'not the or one, goa'"))
scalar("norm_answer_type", ["How many works of {name}?", "What share of {nation}?", "Number of days between", "Total value of {seg}?"], norm.answer_type, _turns("'count'", "'percent'", "'days'", "'money'"))
scalar("norm_own_name", "for Own  Works Ltd by {name}", lambda t: norm.without_name(t, ["Own Works Ltd", "Own Works"]), "'for ' || repeat(' ', 14) || ' by ' || name")


@register("norm_stem", """SELECT DISTINCT w AS word,
  CASE WHEN length(w) > 4 AND ends_with(w, 'ies') THEN left(w, length(w) - 3) || 'y' WHEN length(w) > 5 AND ends_with(w, 'ing') THEN left(w, length(w) - 3)
       WHEN length(w) > 4 AND ends_with(w, 'ed') THEN left(w, length(w) - 2) WHEN length(w) > 4 AND ends_with(w, 'es') THEN left(w, length(w) - 2)
       WHEN length(w) > 3 AND ends_with(w, 's') THEN left(w, length(w) - 1) ELSE w END AS stem
FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM benchmark) WHERE w <> ''""")
def norm_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = bind.table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).filter("word <> ''").distinct()
    return words.select("word", norm.stem(F.col("word")).alias("stem"))


@register("edit_within_one", """SELECT p_partkey, kind, CAST(damerau_levenshtein(a, b) <= 1 AS BOOLEAN) AS near FROM (
  SELECT p_partkey, p_name AS a, unnest([{'kind': 'swap', 'b': substr(p_name, 2, 1) || substr(p_name, 1, 1) || substr(p_name, 3)}, {'kind': 'drop', 'b': substr(p_name, 2)}, {'kind': 'add', 'b': p_name || 'x'},
    {'kind': 'other', 'b': 'q' || substr(p_name, 2)}, {'kind': 'two', 'b': substr(p_name, 3)}], recursive := true) FROM part)""")
def edit_within_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("p_name")
    cut = lambda i, n=1 << 20: F.substring(a, i, n)
    forms = {"swap": F.concat(cut(2, 1), cut(1, 1), cut(3)), "drop": cut(2), "add": F.concat(a, F.lit("x")), "other": F.concat(F.lit("q"), cut(2)), "two": cut(3)}
    rows = bind.table(spark, sf_dir, "part").select("p_partkey", a, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), b.alias("b")) for k, b in forms.items()])).alias("x"))
    return rows.select("p_partkey", "x.kind", resolve.within_one_edit(a, F.col("x.b")).alias("near"))


# ------------------------------------------------------------------ estate tables


def printed(name: str, table: str, prefix: str, template: str, columns: dict[str, str], source: str = "c", **more) -> None:
    """An estate table over one printed document a customer; columns: what SQL says must come out."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _customers(spark, sf_dir)
        texts = rows.select(F.concat(F.lit(prefix), F.col("k").cast("string")).alias("doc"), _print(template, **{c: make() for c, make in more.items()}).alias("text"))
        return estate.TABLES[table](texts).select(*columns)

    register(name, f"SELECT {', '.join(f'{sql} AS {c}' for c, sql in columns.items())} FROM {source}", _C)(query)


def _doc(prefix: str) -> str:
    return f"'{prefix}' || k"


_LATER = {"later": lambda: F.date_add("day", 30)}
_MORE = {"twice": lambda: F.col("n") * 2, "plus": lambda: F.col("n") + F.col("k")}
printed("estate_bond", "bond", "DOC-BOND-", "{seg} Bank\nBond No: BG/{k}-1\nIssue Date: {day}\nTender RFP-{k}\nfor the work of {seg} Works, and a sum not\nexceeding INR {n}\nnor, in any case, not exceeding INR 5\nfor 5% (five) valid from {day} until {later}", {
    "doc": _doc("DOC-BOND-"), "bond_no": "'BG/' || k || '-1'", "issue_date": "day", "bank": "seg || ' Bank'", "tender_ref": "'RFP-' || k", "work": "seg", "amount": "n", "contract_value": "n * 20",
    "valid_until": "CAST(day + 30 AS DATE)", "validity_days": "30", "expiry_year": "CAST(year(day + 30) AS INTEGER)"}, **_LATER)
printed("estate_compliance", "compliance", "DOC-CM-", "Tender Ref: RFP-{k} · {seg} Bid Value INR {n}\nEMD Amount INR {k} Lakh (2.5%)\n1\nTurnover\nComplied\n2\nStaff\nNot Complied\n3\nTools\nN/A", {
    "doc": _doc("DOC-CM-"), "tender_ref": "'RFP-' || k", "work": "seg", "bid_value": "n", "emd_amount": "k * 100000", "emd_pct": "2.5::DOUBLE", "requirements": "3", "complied": "1", "not_complied": "2"})
printed("estate_iso_cert", "iso_cert", "DOC-CERT-", "Certificate No: Q-{k}\nISO 9001:2015\nCertification Body\n{seg}\nInitial Certification Date\n{day}\nValid Until\n{later}\nInitial Certification\n{day}\n{name}\n1 major, {k} minor\nSurveillance Audit 1\n{later}\n{name}\nscheduled, TBD", {
    "doc": _doc("DOC-CERT-"), "cert_no": "'Q-' || k", "standard": "'ISO 9001:2015'", "body": "seg", "initial_date": "day", "validity_days": "30", "major_ncs": "1::BIGINT", "minor_ncs": "k", "audits_done": "1::BIGINT"}, **_LATER)
printed("estate_dossier", "dossier", "DOC-DOSSIER-", "Dossier {seg} Works — Tender RFP-{k}\nBid value: INR {n}\nThe Tender Inviting Authority,\n{name}\nEarnest money of INR {k}\nNorth {seg}\nmega\n40\nSouth {seg}\nsme\n2\nCertificate Copy one", {
    "doc": _doc("DOC-DOSSIER-"), "work": "seg", "rfp_ref": "'RFP-' || k", "bid_value": "n", "client": "name", "emd": "k", "headcount": "42", "cert_copies": "1"})
printed("estate_dossier_standing", "dossier_standing", "DOC-DOSSIER-", "Tender RFP-{k}\n2019-20\nINR {n} Cr\nINR {n}\nRs. {k} Lakh\nend", {
    "doc": _doc("DOC-DOSSIER-"), "rfp_ref": "'RFP-' || k", "year": "2019", "gross_billings": "n * 10000000", "net_turnover": "n", "net_profit": "k * 100000"})
printed("estate_fin_line", "fin_line", "DOC-FS-", "FY2019-20\nA. REVENUE FROM OPERATIONS\n{nation} revenue\n{n}\n{k}\nend", {
    "doc": _doc("DOC-FS-"), "year": "2019", "account": "nation || ' revenue'", "section": "'A. REVENUE FROM OPERATIONS'", "current": "n * 100000", "previous": "k * 100000"})
printed("estate_ra_bill", "ra_bill", "DOC-RABILL-", "Bill No: AR-2020-{k}\nRunning Account Bill — RA 3\nContract #{k} · {name}\nDate: {day}\nValue of work done — this bill\n{n}\nAdd: GST @18%\n180\nLess: Retention @5%\n({k})\nNet claimed (before client TDS)\n{plus}", {
    "doc": _doc("DOC-RABILL-"), "bill_no": "'AR-2020-' || k", "ra": "3", "contract": "CAST(k AS INTEGER)", "client": "name", "date": "day", "year": "CAST(year(day) AS INTEGER)", "value_of_work": "n", "gst": "180::BIGINT", "retention": "k", "net_claimed": "n + k"}, **_MORE)
printed("estate_final_bill", "final_bill", "DOC-FINBILL-", "Contract #{k} · {name} · 2 RA bills\nAwarded Value\nINR {twice}\nRevised Value\nINR {plus}\nPeriod\n{day} — {later}\nTotal\n{n}\nend", {
    "doc": _doc("DOC-FINBILL-"), "contract": "CAST(k AS INTEGER)", "client": "name", "ra_count": "2", "awarded": "n * 2", "executed": "n", "gap": "n", "revised_gap": "k", "period_days": "30"}, **_MORE, **_LATER)
printed("estate_ra_line", "ra_line", "DOC-FINBILL-", "Contract #{k} · {name} · 2 RA bills\n1\nAR-2020-{k}\n{day}\n{n}\n{twice}\nend", {
    "doc": _doc("DOC-FINBILL-"), "ra": "1", "bill_no": "'AR-2020-' || k", "date": "day", "value": "n", "cumulative": "n * 2", "contract": "CAST(k AS INTEGER)"}, **_MORE)
printed("estate_boq_line", "boq_line", "DOC-RABILL-", "Contract #{k} · {name}\n1\n{nation} earth work\ncum\n10\n5.5\n{n}\nend", {"doc": _doc("DOC-RABILL-"), "item": "1", "description": "nation || ' earth work'", "unit": "'cum'", "rate": "10::BIGINT", "quantity": "5.5::DOUBLE", "amount": "n"})
printed("estate_bank_year", "bank_year", "DOC-BANK-", "FY 2020\nOpening balance b/f\n{n}\n{day}\nFee\n{k}\n{less}\n{later}\nFee\n{n}\n0\n{minus}\n{later}\nSale\n{twice}\n{end}\nend", {
    "doc": _doc("DOC-BANK-"), "year": "2020", "opening": "n", "deposits": "n * 2", "withdrawals": "n + k", "closing": "n * 2 - k", "net_movement": "n - k"}, "c",
    less=lambda: F.col("n") - F.col("k"), minus=lambda: F.lit(0) - F.col("k"), end=lambda: F.col("n") * 2 - F.col("k"), **_MORE, **_LATER)
printed("estate_ledger_account", "ledger_account", "DOC-GLB-", "FY 2020\nACCOUNT {k} — {nation} (ASSET)\n{day}\nlong\nname\n{k}\n{n}\nDr\n{later}\nBill\n{n}\n{twice} Cr", {
    "doc": _doc("DOC-GLB-"), "year": "2020", "code": "CAST(k AS INTEGER)", "account": "nation", "account_type": "'Asset'", "closing": "n * 2", "side": "'Cr'", "closing_signed": "-n * 2", "total": "n + k"}, **_MORE, **_LATER)
printed("estate_company_cert", "company_cert", "DOC-CCC-", "Project Name {nation} Client {name} (PSU) Work Category {seg} Contract Value INR {n} Completion Date {day} Project Manager Asha Rao 2. defect liability period of 365 days", {
    "doc": _doc("DOC-CCC-"), "work": "nation", "client": "name", "client_type": "'PSU'", "category": "seg", "value": "n", "completed": "day", "manager": "'Asha Rao'", "defect_liability_days": "365"})
printed("estate_client_cert", "client_cert", "DOC-CC-", "To whom it may concern\nName of Work\n{nation} – Goa Pkg-{k} (old)\nEmployer\n{name} (PSU)\nNature of Work\n{seg}\nExecuted Value\nINR {n} Lacs\nDate of Completion\n{day}\nProject Lead\nDr. Asha Rao\nThe work is graded Good.", {
    "doc": _doc("DOC-CC-"), "work": "nation || ' – Goa Pkg-' || k", "client": "name", "category": "seg", "value": "n * 100000", "completed": "day", "lead": "'Asha Rao'", "grading": "'Good'"})
printed("estate_portfolio", "portfolio", "DOC-PORT-", "Works\n1. {nation} works – Goa Pkg-{k}\nClient\n{name} (JV\nPartner)\nCategory\n{seg}\nExecuted Value\nINR {n}\nCompleted\n{day} - done\n2. no heading", {
    "doc": _doc("DOC-PORT-"), "seq": "1", "work": "nation || ' works – Goa Pkg-' || k", "client": "name", "role": "'JV Partner'", "category": "seg", "value": "n", "completed": "day"})
printed("estate_cv", "cv", "DOC-CV-", "Name\n{name}\nEmployee ID\nE{k}\nDesignation\n{seg} Lead\nTotal Experience\n12 years\nDate of Joining\n{day}", {
    "doc": _doc("DOC-CV-"), "name": "name", "employee_id": "'E' || k", "designation": "seg || ' Lead'", "experience_years": "12", "joined": "day", "tenure_days": "CAST(DATE '2026-03-31' - day AS INTEGER)"})
printed("estate_credential", "credential", "DOC-PCERT-", "This is to certify that\n{name}\nCredential Type\nsix sigma BLACK belt\nCredential ID\nX{k}\nDate of Issue\n{day}\nValid Through\n{later}\nEmployee ID: E{k}", {
    "doc": _doc("DOC-PCERT-"), "name": "name", "credential": "'Six Sigma Black Belt'", "credential_id": "'X' || k", "issued": "day", "validity_days": "30", "employee_id": "'E' || k"}, **_LATER)
printed("estate_reference_letter", "reference_letter", "DOC-REF-", "{name} · Head office\nOur ref: R/{k}\nthe work “{nation}” (INR {n}/-) was completed on {day}, valid for a period of three months", {
    "doc": _doc("DOC-REF-"), "client": "name", "our_ref": "'R/' || k", "work": "nation", "value": "n", "completed": "day", "validity": "'three'"})
printed("estate_order_line", "order_line", "DOC-AR-", "FY 2020\nANNEXURE — ORDER BOOK\n1\n{nation}\nBoard\nitem-\nrate\n{n}\n0\n{plus}\nactive\nANNEXURE — VARIATION ORDERS", {
    "doc": _doc("DOC-AR-"), "seq": "1", "client": "nation || ' Board'", "type": "'item-rate'", "awarded": "n", "variations": "0::BIGINT", "current_value": "n + k", "status": "'active'"}, **_MORE)
printed("estate_order_book", "order_book", "DOC-AR-", "FY 2020\n{k} contracts remained in execution at an aggregate awarded value of INR {n} and approved variations of INR 5 Lakh across 7 variation orders", {
    "doc": _doc("DOC-AR-"), "year": "2020", "contracts_in_execution": "CAST(k AS INTEGER)", "order_book_awarded": "n", "variations_value": "500000::BIGINT", "variation_orders": "7"})
printed("estate_variation", "variation", "DOC-AR-", "FY 2020\nANNEXURE — VARIATION ORDERS\n#{k}\n1\n{slashed}\n-{n}\nscope of {nation}\nCREDIT NOTES ISSUED", {
    "doc": _doc("DOC-AR-"), "year": "2020", "contract": "CAST(k AS INTEGER)", "date": "day", "value_delta": "-n", "reason": "'scope of ' || nation"}, slashed=lambda: F.date_format("day", "dd/MM/yyyy"))
printed("estate_credit_note", "credit_note", "DOC-AR-", "FY 2020\nCREDIT NOTES ISSUED\nCN-2020-{k}\n{slashed}\n{n}\nrefund\nANNEXURE — TRADE", {"credit_note": "'CN-2020-' || k", "date": "day", "amount": "n", "year": "2020"}, slashed=lambda: F.date_format("day", "dd/MM/yyyy"))
printed("estate_ageing", "ageing", "DOC-AR-", "FY 2020\nTRADE RECEIVABLES AGEING\n{nation}\n{n}\n{k}\n5\n{plus}\nend", {"doc": _doc("DOC-AR-"), "year": "2020", "client": "nation", "lt6": "n", "m6_12": "k", "gt12": "5::BIGINT", "total": "n + k"}, **_MORE)
printed("estate_quarter", "quarter", "DOC-AR-", "FY 2020\nQ3 FY 2020-21\n{n}\nend", {"doc": _doc("DOC-AR-"), "quarter": "'Q3'", "year": "2020", "net_revenue": "n"})
printed("estate_principal_client", "principal_client", "DOC-AR-", "FY 2020\nPRINCIPAL CLIENTS\nClient\n1\n{nation}\n{n}\nOrder inflow", {"doc": _doc("DOC-AR-"), "client": "nation", "billings": "n", "year": "2020"})
printed("estate_ar_balance", "ar_balance", "DOC-AR-", "FY 2020\nEQUITY AND LIABILITIES\n{nation} capital\n{n}\nASSETS\nCash\n({k})\nSTATEMENT OF PROFIT AND LOSS", {"doc": "doc", "line": "line", "amount": "amount", "section": "section"},
        "(SELECT 'DOC-AR-' || k AS doc, nation || ' capital' AS line, n AS amount, 'Equity and Liabilities' AS section FROM c UNION ALL SELECT 'DOC-AR-' || k, 'Cash', k, 'Assets' FROM c)")


printed("estate_director", "director", "DOC-AR-", "FY 2020\n{name}\nManaging Director\n4/5\nend", {"name": "name", "designation": "'Managing Director'", "year": "2020"})
printed("estate_ar_line", "ar_line", "DOC-AR-", "FY 2020\n{nation} revenue\nRs. {n} Lakh\nRs. -{k}\nend", {"doc": _doc("DOC-AR-"), "year": "2020", "account": "nation || ' revenue'", "current": "n * 100000", "previous": "-k"})
printed("estate_ar_pl", "ar_pl", "DOC-AR-", "FY 2020\nSTATEMENT OF PROFIT AND LOSS\nParticulars\n2020\n{nation} revenue\n{n}\nNOTES TO THE ACCOUNTS", {"doc": _doc("DOC-AR-"), "year": "2020", "line": "nation || ' revenue'", "amount": "n"})
printed("estate_seven_year", "seven_year", "DOC-AR-", "FY 2020\nSEVEN-YEAR FINANCIAL SUMMARY\n2018-19\n{n}\n{k}\n-5\n2.5%\nANNEXURE", {"year": "2018", "gross_billings": "n", "net_revenue": "k", "profit": "-5::BIGINT", "margin": "2.5::DOUBLE"})
printed("estate_business_unit", "business_unit", "DOC-DOSSIER-", "{name} Unit\nmega\n40\nend", {"unit": "name || ' Unit'", "scale": "'mega'", "headcount": "40"})
printed("estate_audit", "audit", "DOC-CERT-", "Certificate No: Q-{k}\nISO 9001:2015\nSurveillance Audit 2\n{day}\n{name}\n3 major, 1 minor", {
    "type": "'Surveillance Audit 2'", "date": "day", "auditor": "name", "major": "3", "minor": "1", "status": "'completed'", "cert_no": "'Q-' || k", "year": "CAST(year(day) AS INTEGER)"})


@register("estate_segment", "SELECT nation AS segment, 2020 AS year, max(n) FILTER (k = top) AS current FROM (SELECT *, arg_max(k, 'DOC-AR-' || k) OVER (PARTITION BY nation) AS top FROM c) GROUP BY 1 "
          "UNION ALL SELECT nation, 2019, max(k) FILTER (k = top) FROM (SELECT *, arg_max(k, 'DOC-AR-' || k) OVER (PARTITION BY nation) AS top FROM c) GROUP BY 1", _C)
def estate_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own year first, then the comparative; of several reports the last one."""
    rows = _customers(spark, sf_dir)
    texts = rows.select(F.concat(F.lit("DOC-AR-"), F.col("k").cast("string")).alias("doc"), _print("FY 2020\nSEGMENT REVENUE\n{nation}\n{n}\n{k}\nPRINCIPAL CLIENTS").alias("text"))
    return estate.segment(texts).select("segment", "year", "current")


@register("label_values", "SELECT k AS doc, 'client' AS field, name AS value FROM c UNION ALL SELECT k, 'value', CAST(n AS VARCHAR) FROM c WHERE k % 2 = 0", _C)
def label_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(_print("Employer:\n\n{name}\nClient\nanother\n"), F.when(F.col("k") % 2 == 0, _print("Value\n{n}")).otherwise(F.lit("Value\n\n\nlate")))
    rows = extract.lines(_customers(spark, sf_dir).select("k", text.alias("text")), "k", "text", ahead=2)
    return extract.label_values(rows, {"client": "client", "employer": "client", "value": "value"})


@register("serial_rows", "SELECT k AS doc, unnest([1, 2, 3]) AS n, unnest(['Complied', 'N/A', CASE k % 2 WHEN 0 THEN 'Met' ELSE 'Pending' END]) AS status FROM c", _C)
def serial_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(_print("1\n{nation}\nComplied\n9\n2\n3\nN/A\n3\n"), F.when(F.col("k") % 2 == 0, "Met").otherwise("Pending"))
    return extract.serial_rows(_customers(spark, sf_dir).select("k", text.alias("text")), ["complied", "n/a", "met", "pending"], "k", "text")


@register("estate_identities", "SELECT * FROM (VALUES ('ra_bill', 'net = work + gst - retention', (SELECT count(*) FROM c), (SELECT count(*) FILTER (k % 2 = 1) FROM c))) AS t(\"table\", \"constraint\", checked, violated)", _C)
def estate_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = F.col("n") + 180 - F.col("k") + F.when(F.col("k") % 2 == 1, 10).otherwise(0)
    text = _print("Value of work done — this bill\n{n}\nAdd: GST @18%\n180\nLess: Retention @5%\n({k})\nNet claimed (before client TDS)\n{net}", net=net)
    rows = _customers(spark, sf_dir).select(F.concat(F.lit("DOC-RABILL-"), F.col("k").cast("string")).alias("doc"), text.alias("text"))
    return verify.estate_identities({"ra_bill": estate.ra_bill(rows)})


# ------------------------------------------------------------------ filters, joins, checks


def _stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works whose state is unknown for a third and whose role is unknown for all."""
    work = bind.work(spark, sf_dir)
    return work.withColumn("state", F.when(F.col("work_id") % 3 != 0, F.col("state"))).withColumn("grading", F.lit(None).cast("string"))


_STATED = "stated AS (SELECT work_id, client, category, value, year, CASE WHEN work_id % 3 <> 0 THEN state END AS state FROM work)"


@register("filter_conjunction_nulls", "SELECT client, CAST(sum(value) AS BIGINT) AS answer, count(*) AS n_rows FROM stated WHERE state <> 'NATION_7' AND state IS NOT NULL AND year >= 1995 AND category <> '1-URGENT' GROUP BY 1", _WORK, _STATED)
def filter_conjunction_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = QueryPlan("work", (("state", "ne", "NATION_7"), ("state", "exists", True), ("year", "gte", 1995), ("category", "ne", "1-URGENT")), "sum", "value", group_keys=("client",))
    return algebra.run(plan, _stated(spark, sf_dir))


@register("relaxed_select", "SELECT client, CAST(sum(value) AS BIGINT) AS answer, count(*) AS n_rows FROM stated WHERE category = '1-URGENT' GROUP BY 1", _WORK, _STATED)
def relaxed_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grading is stated nowhere, so its filter goes; the category's stays."""
    source = _stated(spark, sf_dir)
    plan = QueryPlan("work", (("category", "eq", "1-URGENT"), ("grading", "eq", "Good")), "sum", "value", group_keys=("client",))
    return algebra.run(algebra.relaxed(plan, source), source)


@register("separating_bars", "SELECT client, CAST(sum(value) AS BIGINT) AS answer, count(*) AS n_rows FROM work WHERE value >= 15000000 GROUP BY 1", _WORK)
def separating_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bar that all rows pass says nothing and goes; the one that parts them stays."""
    source = bind.work(spark, sf_dir)
    plan = QueryPlan("work", (("value", "gte", 15_000_000), ("year", "gte", 1900)), "sum", "value", group_keys=("client",))
    return algebra.run(rewrite.separating_bars(plan, source), source)


@register("latest_by_default", "SELECT category, CAST(sum(value) AS BIGINT) AS answer, count(*) AS n_rows FROM work WHERE year = (SELECT max(year) FROM work) GROUP BY 1", _WORK)
def latest_by_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = bind.work(spark, sf_dir)
    return algebra.run(rewrite.latest_by_default(QueryPlan("work", (), "sum", "value", group_keys=("category",)), source), source)


@register("field_swap", "SELECT client, CAST(sum(value) AS BIGINT) AS answer, count(*) AS n_rows FROM work WHERE year = 1996 GROUP BY 1", _WORK)
def field_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = rewrite.measure_is_not_filter(QueryPlan("work", (("year", "eq", 1996),), "sum", "year", group_keys=("client",)), "value")
    return algebra.run(plan, bind.work(spark, sf_dir))


shaped_absence = "SELECT client, count(*) FILTER (NOT has_ref) AS answer FROM led WHERE contains(lower(category), 'high') GROUP BY 1"


@register("absence_by_category", shaped_absence, _WORK, _LED)
def absence_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.absence(bind.work(spark, sf_dir, lines=True), "High")


@register("absence_all", "SELECT count(*) FILTER (NOT has_ref) AS answer FROM led", _WORK, _LED)
def absence_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All works as one portfolio."""
    return shapes.absence(bind.work(spark, sf_dir, lines=True).withColumn("client", F.lit("*"))).select("answer")


@register("client_universe", """SELECT coalesce(w.client, i.client) AS client, works, value, invoiced, received
FROM (SELECT client, count(*) AS works, CAST(sum(value) AS BIGINT) AS value FROM work WHERE year < 1996 AND value > 20000000 GROUP BY 1) w
FULL JOIN (SELECT client, CAST(sum(invoiced) AS BIGINT) AS invoiced, CAST(sum(received) AS BIGINT) AS received FROM invoice WHERE year > 1996 AND status = 'O' AND invoiced > 5000000 GROUP BY 1) i ON w.client = i.client""", _WORK, _INVOICE)
def client_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients of large early works and of large open invoices: some are in one universe only."""
    return bind.client_universe(bind.work(spark, sf_dir).filter("year < 1996 and value > 20000000"), bind.invoice(spark, sf_dir).filter("year > 1996 and status = 'O' and invoiced > 5000000"))


@register("work_total", "SELECT work_id, CAST(sum(value) OVER (PARTITION BY client) AS BIGINT) AS answer FROM work", _WORK)
def work_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.work_total(bind.work(spark, sf_dir))


@register("works_led", "SELECT lead, list_sort(list(DISTINCT work_id)) AS works FROM led WHERE lead IS NOT NULL GROUP BY 1", _WORK, _LED)
def works_led(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.works_of(bind.work(spark, sf_dir, lines=True), "lead", "work_id", "works")


@register("person_clients", "SELECT client AS name, len(list(work_id)) AS works, CAST(min(work_id) AS BIGINT) AS first FROM work GROUP BY 1", _WORK)
def person_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested children: an ordered list a parent."""
    rows = store.children(bind.work(spark, sf_dir), "client", ["work_id", "value"], "works", ["work_id"])
    return rows.select(F.col("client").alias("name"), F.size("works").cast("bigint").alias("works"), F.get("works", F.lit(0))["work_id"].cast("bigint").alias("first"))


@register(
    "people_of_two_sources",
    "SELECT name, CASE WHEN has THEN 1 ELSE 0 END::BIGINT AS credentials, CASE WHEN seg <> 'BUILDING' THEN seg END AS designation, CASE WHEN seg <> 'BUILDING' THEN 'E' || k ELSE 'H' || k END AS employee_id "
    "FROM (SELECT *, k IN (SELECT o_custkey FROM orders) AS has FROM c) WHERE has OR seg <> 'BUILDING'",
    _C,
)
def people_of_two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with orders hold a credential, those outside one segment have a CV: some have both, some one."""
    rows = _customers(spark, sf_dir)
    key = F.col("k").cast("string")
    ordered = bind.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("bigint").alias("k")).distinct()
    held = rows.join(ordered, "k", "left_semi").select("name", F.lit("PMP").alias("credential"), key.alias("credential_id"), F.col("day").alias("issued"), F.concat(F.lit("D"), key).alias("doc"), F.concat(F.lit("H"), key).alias("employee_id"))
    cvs = rows.filter("seg <> 'BUILDING'").select("name", F.concat(F.lit("V"), key).alias("doc"), F.concat(F.lit("E"), key).alias("employee_id"), F.col("seg").alias("designation"))
    return store.people(held, cvs).select("name", F.size("credentials").cast("bigint").alias("credentials"), "designation", "employee_id")


@register("guarded_spelling", "SELECT k, CASE k % 3 WHEN 2 THEN 'someone else' ELSE name END AS client FROM c", _C)
def guarded_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shouted and loosely punctuated names are spelt as the works spell them; other names stay."""
    rows = _customers(spark, sf_dir)
    said = F.when(F.col("k") % 3 == 0, F.upper("name")).when(F.col("k") % 3 == 1, F.replace("name", F.lit("#"), F.lit(" - "))).otherwise("someone else")
    return store.guarded_spelling(rows.select("k", said.alias("client")), "k", "client", rows.select("k", F.col("name").alias("client")))


@register("canonical_client", "SELECT k, CASE k % 2 WHEN 0 THEN name ELSE 'unknown ' || k END AS client FROM c", _C)
def canonical_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _customers(spark, sf_dir)
    said = F.when(F.col("k") % 2 == 0, F.concat(F.lit(" "), F.lower("name"))).otherwise(_print("unknown {k}"))
    return store.canonical(rows.select("k", said.alias("client")), "client", rows, "name").select("k", "client")


@register("not_included", "SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def not_included(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.not_included(bind.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), bind.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")))


@register("except_customers", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey AS k FROM orders WHERE o_totalprice > 150000")
def except_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = bind.table(spark, sf_dir, "customer"), bind.table(spark, sf_dir, "orders").filter("o_totalprice > 150000")
    return a.select(F.col("c_custkey").alias("k")).subtract(b.select(F.col("o_custkey").alias("k")))


@register("reconcile_agreeing", """SELECT k, field, l AS left, r AS right FROM (
  SELECT work_id AS k, 'value' AS field, CAST(value AS VARCHAR) AS l, CAST(value + 5 AS VARCHAR) AS r FROM work WHERE work_id % 7 = 0
  UNION ALL SELECT work_id, 'client', client, 'other' FROM work WHERE work_id % 11 = 0)""", _WORK)
def reconcile_agreeing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readings that agree but for planted differences; a rupee apart and unstated fields are none."""
    a = bind.work(spark, sf_dir).select(F.col("work_id").alias("k"), "value", "client", "state")
    off = F.when(F.col("k") % 7 == 0, 5).when(F.col("k") % 5 == 0, 1).otherwise(0)
    b = a.withColumns({"value": F.col("value") + off, "client": F.when(F.col("k") % 11 == 0, "other").otherwise(F.col("client")), "state": F.lit(None).cast("string")})
    return verify.reconcile(a, b, "k", {"value": 2, "client": 0, "state": 0})


@register("agreement", "SELECT 'client' AS field, count(*) AS \"both\", count(*) FILTER (work_id % 11 <> 0) AS agree FROM work WHERE work_id % 2 = 0 UNION ALL SELECT 'value', count(*), count(*) FROM work WHERE work_id % 2 = 0", _WORK)
def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = bind.work(spark, sf_dir).select("work_id", "client", "value")
    b = a.filter("work_id % 2 = 0").select("work_id", F.when(F.col("work_id") % 11 == 0, "other").otherwise(F.upper("client")).alias("name"), "value")
    return verify.agreement(a, b, "work_id", {"client": "name", "value": "value"})


@register("census", "SELECT category, found, pinned FROM (SELECT category, count(*) AS found FROM work GROUP BY 1) FULL JOIN (VALUES ('1-URGENT', 1::BIGINT), ('none', 2::BIGINT)) AS t(category, pinned) USING (category)", _WORK)
def census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.census(bind.work(spark, sf_dir), "category", {"1-URGENT": 1, "none": 2})


@register("catalog_counts", "SELECT 'customer' AS \"table\", count(*) AS rows FROM customer UNION ALL SELECT 'nation', count(*) FROM nation")
def catalog_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.catalog({t: bind.table(spark, sf_dir, t) for t in ("customer", "nation")}).select("table", "rows")


# ------------------------------------------------------------------ resolution


@register("resolve_names", "SELECT 'the ' || lower(name) || ' people' AS mention, name, false AS ambiguous FROM c UNION ALL SELECT 'nobody', NULL, false UNION ALL SELECT lower(name), name, false FROM c", _C)
def resolve_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact names, names within other words, and someone whom nobody knows."""
    names = _customers(spark, sf_dir).select("name")
    said = names.select(F.concat(F.lit("the "), F.lower("name"), F.lit(" people")).alias("mention")).unionByName(names.select(F.lower("name").alias("mention")))
    said = said.unionByName(spark.range(1).select(F.lit("nobody").alias("mention")))
    return resolve.resolve(said, names).select("mention", "name", "ambiguous")


@register("resolve_siblings", "SELECT 'the ' || lower(n_name) || ' water board' AS mention, 'Water Board ' || n_name AS name, false AS ambiguous FROM nation UNION ALL SELECT 'our water board', NULL, true", _C)
def resolve_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that share all words but one: the shared ones alone are ambiguous, not absent."""
    names = bind.table(spark, sf_dir, "nation").select(F.concat(F.lit("Water Board "), F.col("n_name")).alias("name"), "n_name")
    said = names.select(F.concat(F.lit("the "), F.lower("n_name"), F.lit(" water board")).alias("mention"))
    return resolve.resolve(said.unionByName(spark.range(1).select(F.lit("our water board").alias("mention"))), names.select("name")).select("mention", "name", "ambiguous")


@register("contiguous_run", "SELECT k, CAST(CASE WHEN k % 3 = 0 THEN 2 WHEN k % 3 = 1 THEN 4 ELSE 2 END AS INTEGER) AS run FROM c", _C)
def contiguous_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer's name and nation, said alone, together, or the other way round."""
    said = F.when(F.col("k") % 3 == 0, F.concat(F.lit("the "), F.lower("name"), F.lit(" of it"))).when(F.col("k") % 3 == 1, F.concat_ws(" ", F.lit("our"), "name", "nation", F.lit("office")))
    said = said.otherwise(F.concat_ws(" ", F.lit("in"), "nation", F.lit("the"), "name"))
    return _customers(spark, sf_dir).select("k", resolve.contiguous_run(said, F.concat_ws(" ", "name", "nation")).alias("run"))


# ------------------------------------------------------------------ questions

_VALUES = {
    "work": {"category": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], "role": ["F", "O", "P"], "client_type": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"], "state": [f"NATION_{i}" for i in range(25)]},
    "invoice": {}, "asset": {"condition": ["good", "fair", "worn"]},
}


def asked(name: str, question: str, sql: str, *ctes: str) -> None:
    """A question in plain words, as the planner compiles it."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        vocabulary = Vocabulary({e: {c: {v.lower(): v for v in vs} for c, vs in columns.items()} for e, columns in _VALUES.items()})
        made = compile_question(question, vocabulary)
        if made.plan is None:
            raise ValueError(made.reason)
        source = bind.entity(spark, sf_dir, made.plan.entity, made.plan.columns())
        return algebra.run(made.plan, source).select(F.col("answer").cast("double").alias("answer"))

    register(name, f"SELECT CAST(({sql}) AS DOUBLE) AS answer", *(ctes or (_WORK,)))(query)
    _ASKED.append((name, question, sql))


#: (name, question, SQL) of all questions that the planner answers; ``answer_batch`` answers them together.
_ASKED: list[tuple[str, str, str]] = []


_ASSET = "asset AS (SELECT p_type AS type, CAST(round(p_retailprice * 100) AS BIGINT) AS cost, CASE WHEN p_size < 15 THEN 'good' WHEN p_size < 35 THEN 'fair' ELSE 'worn' END AS condition FROM part)"
asked("ask_total", "What is the total value of 1-URGENT works in NATION_7?", "SELECT sum(value) FROM work WHERE category = '1-URGENT' AND state = 'NATION_7'")
asked("ask_negated", "How many works in 1996 were not 5-LOW?", "SELECT count(*) FROM work WHERE year = 1996 AND category <> '5-LOW'")
asked("ask_misspelt", "What is the averge value of works in NATION_3?", "SELECT round_even(avg(value), 0) FROM work WHERE state = 'NATION_3'")
asked("ask_bar", "How many projects are worth more than INR 2 Cr?", "SELECT count(*) FROM work WHERE value >= 20000000")
asked("ask_worded_bar", "How many projects are worth at least twenty lakh?", "SELECT count(*) FROM work WHERE value >= 2000000")
asked("ask_median", "What is the median value of works in NATION_12?", "SELECT round_even(median(value), 0) FROM work WHERE state = 'NATION_12'")
asked("ask_largest", "Which is the largest work value of BUILDING clients?", "SELECT max(value) FROM work WHERE client_type = 'BUILDING'")
asked("ask_delta", "By how much did the total value of works change between 1995 and 1997?", "SELECT abs(sum(value) FILTER (year = 1997) - sum(value) FILTER (year = 1995)) FROM work")
asked("ask_ratio", "What share of the value of works is 2-HIGH?", f"SELECT round_even(sum(value) FILTER (category = '2-HIGH') * 10000.0::DOUBLE / sum(value), 0) / 100 FROM work")
asked("ask_groupby", "Which category has the highest total value of works?", "SELECT max(s) FROM (SELECT sum(value) AS s FROM work GROUP BY category)")
asked("ask_fewest", "Which state has the fewest works?", "SELECT min(s) FROM (SELECT count(*) AS s FROM work GROUP BY state)")
asked("ask_distinct", "How many different categories of works are there in NATION_7?", "SELECT count(DISTINCT category) FROM work WHERE state = 'NATION_7'")
asked("ask_spread", "What is the spread of dates of works in NATION_12, first to the last?", "SELECT date_diff('day', min(completed), max(completed)) FROM work WHERE state = 'NATION_12'")
asked("ask_epoch", "How many days after 1 January 1992 was the last work in NATION_12 completed?", "SELECT date_diff('day', DATE '1992-01-01', max(completed)) FROM work WHERE state = 'NATION_12'")
asked("ask_years", "What is the total value of works between 1995 and 1996, in all?", "SELECT sum(value) FROM work WHERE year BETWEEN 1995 AND 1996")
for _name, _question, _sql in [
    ("outside", "How many works outside NATION_7?", "count(*) FROM work WHERE state <> 'NATION_7'"),
    ("besides", "How many works are there besides 1-URGENT and 5-LOW ones?", "count(*) FROM work WHERE category NOT IN ('1-URGENT', '5-LOW')"),
    ("rather_than", "What is the median value of works in NATION_3 rather than 2-HIGH?", "round_even(median(value), 0) FROM work WHERE state = 'NATION_3' AND category <> '2-HIGH'"),
    ("two_values", "What is the total value of works in NATION_3 or NATION_7?", "sum(value) FROM work WHERE state IN ('NATION_3', 'NATION_7')"),
    ("between_amounts", "How many works cost between INR 1 Cr and INR 2 Cr?", "count(*) FROM work WHERE value BETWEEN 10000000 AND 20000000"),
    ("shared_unit", "How many works are worth from 1 to 2 crore in NATION_7?", "count(*) FROM work WHERE value BETWEEN 10000000 AND 20000000 AND state = 'NATION_7'"),
    ("or_less", "How many works are worth INR 50 lakh or less?", "count(*) FROM work WHERE value <= 5000000"),
    ("not_more", "What is the largest value of works that cost not more than INR 90 lakh?", "max(value) FROM work WHERE value <= 9000000"),
    ("half", "How many works are worth at least one and a half crore?", "count(*) FROM work WHERE value >= 15000000"),
    ("before_year", "How many works were completed before 1996?", "count(*) FROM work WHERE year < 1996"),
    ("after_day", "How many works were completed after 12 March 1996?", "count(*) FROM work WHERE completed > DATE '1996-03-12'"),
    ("on_or_after", "What is the total value of works completed on or after 12 March 1996 in NATION_7?", "sum(value) FROM work WHERE completed >= DATE '1996-03-12' AND state = 'NATION_7'"),
    ("until", "How many works were completed until 30 June 1995?", "count(*) FROM work WHERE completed <= DATE '1995-06-30'"),
    ("listed_years", "What is the average value of works in 1993, 1995 and 1997?", "round_even(avg(value), 0) FROM work WHERE year IN (1993, 1995, 1997)"),
    ("from_to", "How many 1-URGENT works from 1994 to 1996?", "count(*) FROM work WHERE year BETWEEN 1994 AND 1996 AND category = '1-URGENT'"),
    ("onwards", "What is the smallest value of works from 1997 onwards?", "min(value) FROM work WHERE year >= 1997"),
    ("month", "How many works were completed in March 1996?", "count(*) FROM work WHERE completed BETWEEN DATE '1996-03-01' AND DATE '1996-03-31'"),
    ("between_days", "What is the total value of works between 15 January 1995 and 3 March 1995?", "sum(value) FROM work WHERE completed BETWEEN DATE '1995-01-15' AND DATE '1995-03-03'"),
    ("not_year", "How many works were not in 1996?", "count(*) FROM work WHERE year <> 1996"),
    ("believed", "I believe it was INR 5 Cr. How many works are in NATION_7?", "count(*) FROM work WHERE state = 'NATION_7'"),
]:
    asked(f"ask_{_name}", _question, f"SELECT {_sql}")
asked("ask_diff", "What is the difference between invoiced and received on all invoices?", "SELECT sum(invoiced) - sum(received) FROM invoice", _INVOICE)
asked("ask_invoice_year", "How much was received on invoices in 1997, in total?", "SELECT sum(received) FROM invoice WHERE year = 1997", _INVOICE)
asked("ask_asset", "What is the total cost of equipment that is worn?", "SELECT sum(cost) FROM asset WHERE condition = 'worn'", _ASSET)
asked("ask_nonzero", "How many assets have a non-zero cost?", "SELECT count(*) FROM asset WHERE cost > 0", _ASSET)

_CLIENT, _OTHER, _LEADER = "Customer#000000007", "Customer#000000010", "Supplier#000000001"
_OWN = f"client = '{_CLIENT}'"


def _works(select: str, where: str = "true", table: str = "led") -> str:
    return f"(SELECT {select} FROM {table} WHERE {_OWN} AND {where})"


#: (question, SQL of its answer): one for every shape, then some that go to the planner or nowhere.
_ROUTED = [
    ("What is the total value of works for {c}?", _works("sum(value)")),
    ("What is the average value of works for {c}?", _works("round_even(avg(value), 0)")),
    ("How far is the mean work value of {c} from the median?", _works("round_even(avg(value) - median(value), 0)")),
    ("By how much did the works value of {c} change between 1993 and 1996?", _works("abs(coalesce(sum(value) FILTER (year = 1996), 0) - coalesce(sum(value) FILTER (year = 1993), 0))")),
    ("Total value {c} gave us as F", _works("coalesce(sum(value) FILTER (role = 'F'), 0)")),
    ("Total value of {c} works graded BUILDING", _works("coalesce(sum(value) FILTER (client_type = 'BUILDING'), 0)")),
    ("For {c}, what separates 1-URGENT from 2-HIGH in value?", _works("abs(coalesce(sum(value) FILTER (category = '1-URGENT'), 0) - coalesce(sum(value) FILTER (category = '2-HIGH'), 0))")),
    ("Value of {c} works excluding 5-LOW", _works("sum(value) FILTER (category <> '5-LOW')")),
    ("How far is {c} short of INR 900 Cr?", _works("greatest(0, 9000000000 - sum(value))")),
    ("How much of what {c} awarded is not yet billed, awarded against billed?", f"abs({_works('sum(value)')} - {_works('sum(invoiced)', table='invoice')})"),
    ("How much have we billed {c} in total?", _works("sum(invoiced)", table="invoice")),
    ("How much did we collect, total received from {c}?", _works("sum(received)", table="invoice")),
    ("What does {c} still owe?", _works("sum(invoiced) - sum(received)", table="invoice")),
    ("Total value of {c} works above INR 1 Cr", _works("sum(value) FILTER (value >= 10000000)")),
    ("Gap between the two largest works of {c}", _works("max(value) - list_sort(list(value), 'DESC')[2]")),
    ("Value of works completed in 1996 for {c}", _works("sum(value) FILTER (year = 1996)")),
    ("What percentage of the {c} works has a reference letter?", _works("round_even(count(*) FILTER (has_ref) * 10000.0::DOUBLE / count(*), 0) / 100")),
    ("What percentage of the invoiced amount was collected from {c}?", _works("round_even(sum(received) * 10000.0::DOUBLE / sum(invoiced), 0) / 100", table="invoice")),
    ("How many works of {c} lack a reference letter?", _works("count(*) FILTER (NOT has_ref)")),
    ("How many different categories did {c} give us?", _works("count(DISTINCT category)")),
    ("Total value of works that {p} completed after the credential", f"(SELECT sum(value) FILTER (completed > issued) FROM led JOIN credential ON lead = name WHERE lead = '{_LEADER}')"),
    ("How many days between the credential of {p} and the last work?", f"(SELECT abs(date_diff('day', min(issued), max(completed))) FROM led JOIN credential ON lead = name WHERE lead = '{_LEADER}')"),
    ("Total value of the portfolio behind {p}", f"(SELECT sum(value) FROM work WHERE client = (SELECT arg_min(client, work_id) FROM led WHERE lead = '{_LEADER}'))"),
    ("What is the largest work value for {c}?", _works("max(value)")),
    ("What is the total value for Customer#000000999999 works excluding 5-LOW?", "NULL"),
    ("How is the weather?", "NULL"),
]


@register("answer_questions", "SELECT * FROM (VALUES " + ", ".join(f"('q{i:02}', CAST({sql} AS DOUBLE))" for i, (_, sql) in enumerate(_ROUTED)) + ") AS t(qid, answer)", _WORK, _LED, _INVOICE, _CREDENTIAL)
def answer_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole loop from the text of a question to its number; names that it looks for are given."""
    known = Known(
        clients=(_CLIENT, _OTHER), people=(_LEADER, "Supplier#000000002"), categories=tuple(_VALUES["work"]["category"]), roles=("F", "O", "P"), gradings=tuple(_VALUES["work"]["client_type"]),
    )
    vocabulary = Vocabulary({"work": {"category": {v.lower(): v for v in _VALUES["work"]["category"]}}})
    work = bind.work(spark, sf_dir, lines=True).withColumn("grading", F.col("client_type"))
    tables = {"work": work, "invoice": bind.invoice(spark, sf_dir), "credential": bind.credential(spark, sf_dir)}
    questions = [(f"q{i:02}", text.replace("{c}", _CLIENT).replace("{p}", _LEADER), None) for i, (text, _) in enumerate(_ROUTED)]
    return answer_all(spark, questions, known, vocabulary, tables).select("qid", "answer")


def vocabulary_of(tables: dict[str, DataFrame], questions: list[str]) -> Vocabulary:
    """What the questions say of the tables' values, by an index over all of them."""
    return Vocabulary.of_tables(tables, ValueIndex.of(tables), questions)


@register("answer_batch", "SELECT * FROM (VALUES " + ", ".join(f"('{name}', CAST(({sql}) AS DOUBLE))" for name, _, sql in _ASKED) + ") AS t(qid, answer)", _WORK, _INVOICE, _ASSET)
def answer_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All questions above as one batch: values found by an index over every column, plans of one table answered by shared scans.

    The values that the questions name are given too, for tables that don't hold them; a question without an answer raises.
    """
    tables = {"work": bind.work(spark, sf_dir), "invoice": bind.invoice(spark, sf_dir), "asset": bind.asset(spark, sf_dir)}
    vocabulary = vocabulary_of(tables, [q for _, q, _ in _ASKED]).also(_VALUES)
    return answer_all(spark, [(name, q, None) for name, q, _ in _ASKED], Known(), vocabulary, tables, strict=True).select("qid", "answer")


_REWORDED = [(name, rewrite) for name, question, _ in _ASKED for rewrite in rewording.rewordings(question)]


@register(
    "answer_reworded",
    "SELECT r.qid, rewrite, answer FROM (VALUES " + ", ".join(f"('{q}', '{r}')" for q, r in _REWORDED) + ") AS r(qid, rewrite) JOIN (VALUES "
    + ", ".join(f"('{name}', CAST(({sql}) AS DOUBLE))" for name, _, sql in _ASKED) + ") AS g(qid, answer) USING (qid)",
    _WORK, _INVOICE, _ASSET,
)
def answer_reworded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question above in all its rewordings, as one batch."""
    tables = {"work": bind.work(spark, sf_dir), "invoice": bind.invoice(spark, sf_dir), "asset": bind.asset(spark, sf_dir)}
    return rewording.reworded_answers(spark, [(name, q) for name, q, _ in _ASKED], Known(), lambda texts: vocabulary_of(tables, texts), tables).select("qid", "rewrite", "answer")


@register("index_whole", "SELECT 'customer' AS \"table\", 'c_name' AS \"column\", lower(replace(c_name, '#', ' ')) AS run, c_name AS value FROM customer UNION ALL SELECT 'nation', 'n_name', lower(replace(n_name, '_', ' ')), n_name FROM nation")
def index_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value index of all names of customers and nations."""
    tables = {"customer": bind.table(spark, sf_dir, "customer").select("c_name"), "nation": bind.table(spark, sf_dir, "nation").select("n_name")}
    return ValueIndex.of(tables).whole


@register(
    "index_hits",
    "SELECT o_orderkey AS q, count(DISTINCT n) FILTER (kind = 'c') AS clients, count(DISTINCT n) FILTER (kind = 's') AS states FROM "
    "(SELECT o_orderkey, c_name AS n, 'c' AS kind FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT o_orderkey, n_name, 's' FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) GROUP BY 1",
)
def index_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question an order that names its client and state, looked up in the index of all names by their own runs of words."""
    customers, nations = bind.table(spark, sf_dir, "customer"), bind.table(spark, sf_dir, "nation")
    index = ValueIndex.of({"customer": customers.select("c_name"), "nation": nations.select("n_name")})
    asked = bind.table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    said = F.concat(F.lit("what is the value of works of "), F.col("c_name"), F.lit(" in "), F.col("n_name"), F.lit("?"))
    hits = index.hits(asked.select(F.col("o_orderkey").alias("q"), word_list(said).alias("words"))).filter("whole")
    kind = lambda t: F.count_distinct(F.when(F.col("table") == t, F.col("value")))
    return hits.groupBy("q").agg(kind("customer").alias("clients"), kind("nation").alias("states"))


# ------------------------------------------------------------------ hot keys


@register("median_hot", "SELECT client, CAST(median(value) AS DOUBLE) AS median FROM (SELECT '*' AS client, value FROM work UNION ALL SELECT client, value FROM work) GROUP BY 1", _WORK)
def median_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of all clients, and of all works as one client, which is never sorted in one task."""
    work = bind.work(spark, sf_dir).select("client", "value")
    return hot.median(work.withColumn("client", F.lit("*")).unionByName(work), "client", "value", small=1_000)


_EVERY = "SELECT event_id, '*' AS who, value_cents AS v, ts FROM (SELECT event_id, ts, CAST(round(value * 100) AS BIGINT) AS value_cents FROM events)"


def _one_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.table(spark, sf_dir, "events").select("event_id", F.lit("*").alias("who"), "ts", F.round(F.col("value") * 100).cast("bigint").alias("v"))


@register("running_hot", f"SELECT event_id, CAST(sum(v) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance FROM ({_EVERY})")
def running_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running sum over all events as one account, block by block."""
    return hot.running(_one_user(spark, sf_dir), "who", ["ts", "event_id"], F.col("v"), "balance").select("event_id", "balance")


@register("previous_hot", f"SELECT event_id, lag(v) OVER (ORDER BY ts, event_id) AS before FROM ({_EVERY})")
def previous_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value before, over all events as one account."""
    return hot.previous(_one_user(spark, sf_dir), "who", ["ts", "event_id"], "v", "before").select("event_id", "before")


@register("leaders_overall", "SELECT client, total FROM (SELECT client, CAST(sum(value) AS BIGINT) AS total FROM work GROUP BY 1) ORDER BY total DESC, client LIMIT 5", _WORK)
def leaders_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five clients with the largest total value."""
    return hot.leaders(bind.work(spark, sf_dir).groupBy("client").agg(F.sum("value").alias("total")), 5, "total", "client")


@register("leaders_by_state", "SELECT state, work_id, value FROM work QUALIFY row_number() OVER (PARTITION BY state ORDER BY value DESC, work_id) <= 5", _WORK)
def leaders_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest works of every state."""
    return hot.leaders(bind.work(spark, sf_dir).select("state", "work_id", "value"), 5, "value", "work_id", "state")
