"""Scalar functions, extraction, resolution, compilation and sources."""

import datetime as dt
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions import norm
from tessera.operators import extract, resolve
from tessera.plans.mine import NameIndex
from tessera.plans.compile import Vocabulary, compile_question
from tessera.sources import readers
from tessera.streaming import balances


def one(spark, fn, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("t"))).collect()]


def test_money(spark):
    assert one(spark, norm.money, "INR 33.38 Cr", "Rs. 33.38 Crore", "3,338.00 Lakh", "INR 33,38,00,000/-", "INR 81.44 Cr", "(2,464,151)", "none", None) == [
        333800000, 333800000, 333800000, 333800000, 814400000, -2464151, None, None]


def test_money_units_and_signs(spark):
    assert one(spark, norm.money, "INR 5 Lacs", "5 lac", "-5 Cr", "INR -2,464,151", "Rs.-7", "(INR 2 Cr)", "-1,234.5", "₹ 12.5 crores", "") == [
        500000, 500000, -50000000, -2464151, -7, -20000000, -1234, 125000000, None]
    assert one(spark, norm.threshold, "INR 5 Lacs", "above five lac", "over 12 lacs", "10,00,00,000 Cr", "500000000 or more", "in 2020") == [500000, 500000, 1200000, 10**15, 500000000, None]


def test_masks_keep_places(spark):
    text = "per ISO 9001:2015 and OHSAS 18001, ref BOARD/2026/003 of 28/08/2022, days after 1 January 2010"
    for mask, gone in ((norm.mask_standards, ["ISO 9001:2015", "OHSAS 18001"]), (norm.mask_refs, ["BOARD/2026/003"]), (norm.mask_epoch, ["days after 1 January 2010"])):
        want = text
        for g in gone:
            want = want.replace(g, " " * len(g))
        assert one(spark, mask, text, "nothing here", "", None) == [want, "nothing here", "", None]
    assert one(spark, lambda t: norm.without_name(t, ["Own Works Ltd", "Own Works"]), "for Own  Works Ltd and Own Worksite") == ["for" + " " * 16 + "and Own Worksite"]


def test_fiscal_years_in_texts(spark):
    assert one(spark, norm.fiscal_years, "the year ended 31 March 2020 and as at 31st March, 2021", "in 2020", "FY2019-20", None) == ["FY2019-20 and FY2020-21", "in 2020", "FY2019-20", None]


def test_grades_and_credentials(spark):
    assert one(spark, norm.grading, "The work is graded as Very\nGood.", "is graded Good", "We have assessed the completed work as Fair", "The representative assessed it on site as Excellent.",
               "found satisfactory on inspection", "graded as Splendid", None) == ["Very Good", "Good", "Fair", "Excellent", None, None, None]
    assert one(spark, norm.credential_name, "pmp", "SIX SIGMA  black belt", "CSSBB", "chartered engineer", None, "") == ["PMP", "Six Sigma Black Belt", "Six Sigma Black Belt", "Chartered Engineer", None, None]


def test_sections_have_no_cap_before_their_end(spark):
    long = "<A>" + "row\n" * 10_000 + "<B>tail"
    assert one(spark, lambda t: F.length(norm.section(t, "<A>", "<B>")), long, long[:-7]) == [40_000, 12_000]


def test_negated_words_and_capitals(spark):
    assert one(spark, lambda t: norm.without_negated(t, ["gujarat", "odisha"]), "phed odisha not gujarat", "not the Odisha or Gujarat one, odisha", "a gujarat not") == ["phed odisha not", "not the or one, odisha", "a gujarat not"]
    fold = lambda t: norm.folded(t, {"pwd": "public works department"}, capital={"UP": "uttar pradesh"}, beside=["irrigation", "jal nigam"])
    assert one(spark, fold, "UP PWD", "pulling up", "the up irrigation file", "jal nigam up") == ["uttar pradesh public works department", "pulling up", "the uttar pradesh irrigation file", "jal nigam uttar pradesh"]
    assert one(spark, norm.word_stem, "parties", "invoices", "invoiced", "total") == ["parti", "invoic", "invoic", "total"]


def test_numbers_and_bars(spark):
    assert one(spark, norm.words_to_number, "seventy-three", "two hundred five", "nothing", None) == [73, 205, None, None]
    assert one(spark, norm.threshold, "works crossing the seventy-three crore mark", "credential target of INR 20 Cr", "above 5,00,00,000 in all") == [730000000, 200000000, 50000000]


def test_dates(spark):
    d = dt.date
    assert one(spark, norm.parse_date, "06/02/2011", "2011-02-06", "December 8, 2012", "31 Mar 2026", "31/02/2020", "soon", None) == [
        d(2011, 2, 6), d(2011, 2, 6), d(2012, 12, 8), d(2026, 3, 31), None, None, None]
    assert one(spark, norm.fiscal_label, "year ended 31 March 2020", "year ended 31 March 2000") == ["FY2019-20", "FY1999-00"]


def test_names(spark):
    assert one(spark, norm.norm_client, " Water  Board (PSU) ", "Acme.", "X (Publications Board)", "X (Semi-Govt)", "(Private)", None) == ["Water Board", "Acme", "X (Publications Board)", "X", "", None]
    assert one(spark, norm.norm_person, "Mr. A B.", "Mr", "Drew B", "SHRI  A", None) == ["A B", "Mr", "Drew B", "A", None]
    assert one(spark, norm.norm_work, "Road – Phase II, (Pkg-3)") == ["road phase ii pkg 3"]
    assert one(spark, norm.norm_person, "Dr. A  Rao") == ["A Rao"]
    assert one(spark, norm.stem, "parties", "building", "roads", "glass") == ["party", "build", "road", "glas"]
    assert one(spark, norm.answer_type, "How many works?", "What share of works?", "Number of days between", "Total value?") == ["count", "percent", "days", "money"]
    assert one(spark, norm.state_of, "Canal lining – Kerala Pkg-7") == ["Kerala"]
    assert one(spark, lambda t: norm.after_label(t, "Employer"), "x\nEmployer:\n  Acme Ltd \ny") == ["Acme Ltd"]
    assert one(spark, lambda t: norm.section(t, "<A>", "<B>"), "0<A>in<B>out", "none") == ["in", None]


def test_folding_and_masks(spark):
    assert one(spark, lambda t: norm.folded(t, {"dept": "department", "govt": "government"}), "Water Dept. & Govt  of X") == ["water department and government of x"]
    assert one(spark, lambda t: norm.masked(t, r"\bISO \d+\b"), "per ISO 9001 and 9001") == ["per          and 9001"]
    assert one(spark, norm.without_trailing_note, "Canal (old)", "Canal (Pkg-3)") == ["Canal", "Canal (Pkg-3)"]
    assert one(spark, norm.lenient_year, "2020-01-01T00", "x", None) == [2020, None, None]
    assert one(spark, norm.lenient_date, "2020-01-05T00", "2020-13-01") == [dt.date(2020, 1, 5), None]
    assert one(spark, norm.number, "(2,464,151)", "12", "-3", "x") == [-2464151, 12, -3, None]


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_labels_blocks_and_sections(spark):
    rows = extract.lines(docs(spark, "Client:\n\nAcme\nClient\nOther\nValue\n5", None, ""))
    got = {(r["doc"], r["field"]): r["value"] for r in extract.label_values(rows, {"client": "client", "value": "amount"}).collect()}
    assert got == {(0, "client"): "Acme", (0, "amount"): "5"}
    rows = extract.lines(docs(spark, "a\nHEAD\nb\nc\nHEAD2\nd"))
    block = [r["block"] for r in extract.blocks(rows, F.col("line").startswith("HEAD")).orderBy("pos").collect()]
    assert block == [0, 1, 1, 1, 2, 2]
    section = [r["section"] for r in extract.asof_section(rows, F.col("line").startswith("HEAD")).orderBy("pos").collect()]
    assert section == [None, "HEAD", "HEAD", "HEAD", "HEAD2", "HEAD2"]
    runs = extract.run_of_lines(extract.lines(docs(spark, "1\nBolt\n5.0\nx\n2\nNut\n7")), [r"^\d+$", "^[A-Z]", r"^\d"]).orderBy("pos").collect()
    assert [(r["field_0"], r["field_1"], r["field_2"]) for r in runs] == [("1", "Bolt", "5.0"), ("2", "Nut", "7")]


def test_sections_within_the_row_equal_windows(spark):
    texts = docs(spark, "a\nHEAD\nb\n\nHEAD2\nHEAD3\nd", "HEAD\nx", "no\nheads", "", None, "HEAD")
    rows, starts = extract.lines(texts), lambda line: line.startswith("HEAD")
    by_window = extract.blocks(extract.asof_section(rows, starts(F.col("line"))), starts(F.col("line")))
    columns = ["doc", "pos", "line", "section", "block"]
    found = extract.sections(texts, starts)
    assert sorted(map(str, found.select(columns).collect())) == sorted(map(str, by_window.select(columns).collect()))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    ahead = extract.lines(texts, ahead=2)
    assert sorted(map(str, ahead.collect())) == sorted(map(str, extract.next_lines(rows, 1, 2).collect()))


def test_serial_rows(spark):
    got = extract.serial_rows(docs(spark, "1\nfoo\nComplied\n9\n2\n3\nN/A\n3\nPending", None), ["complied", "n/a", "pending"]).orderBy("n").collect()
    assert [(r["n"], r["status"]) for r in got] == [(1, "Complied"), (2, "N/A"), (3, "Pending")]


def test_statement_direction(spark):
    rows = spark.createDataFrame([("d", 1, 50, 150, 100), ("d", 2, 30, 120, 100), ("d", 3, 5, 125, 100)], "doc string, pos int, amount long, balance long, opening long")
    got = extract.statement_rows(rows, "doc", "pos", "amount", "balance", "opening").orderBy("pos").collect()
    assert [(r["deposit"], r["withdrawal"]) for r in got] == [(50, 0), (0, 30), (5, 0)]


def test_doc_type_longest_prefix_and_totals(spark):
    assert one(spark, lambda t: extract.doc_type(t, {"DOC-CC-": "copy", "DOC-CCC-": "cert", "DOC-": "any"}), "DOC-CC-1", "DOC-CCC-1", "DOC-9", "X") == ["copy", "cert", "any", None]
    assert extract.without_totals(spark.createDataFrame([("1",), ("TOTAL",), (None,)], "n string"), "n").count() == 1


def test_resolution_refuses(spark):
    names = spark.createDataFrame([("North Water Board",), ("South Water Board",), ("City Metro Rail",)], "name string")
    said = spark.createDataFrame([("north water board",), ("the metro rail people",), ("water board",), ("nobody",), (None,)], "mention string")
    got = {r["mention"]: (r["name"], r["ambiguous"]) for r in resolve.resolve(said, names).collect()}
    assert got == {"north water board": ("North Water Board", False), "the metro rail people": ("City Metro Rail", False), "water board": (None, True), "nobody": (None, False)}
    df = spark.createDataFrame([("median", "mediam"), ("total", "toatl"), ("total", "totally"), ("a", "b")], "a string, b string")
    assert [r[0] for r in df.select(resolve.within_one_edit(F.col("a"), F.col("b"))).collect()] == [True, True, False, True]
    df = spark.createDataFrame([("the north water works", "north water board"), ("x", "")], "t string, p string")
    assert [r[0] for r in df.select(resolve.contiguous_run(F.col("t"), F.col("p"))).collect()] == [2, 0]


def test_names_of_frequent_words_resolve(spark):
    """512 names of which every word stands in 64; and brute force over random mentions."""
    words = [f"{place}{k}" for place in "abc" for k in range(8)]
    names = [f"a{i} b{j} c{k}" for i in range(8) for j in range(8) for k in range(8)]
    names += ["a1 rare", "b2 c2 rare seldom", "c3"]
    pick = random.Random(5)
    said = ["the a3 b4 c5 people"] + [" ".join(pick.sample(words + ["rare", "seldom", "other"], pick.randint(1, 4))) + " x" for _ in range(60)]
    df = Counter(t for n in names for t in n.split())
    want = {}
    for m in set(said):
        scores = {}
        for n in names:
            got = round(sum(1 / df[t] for t in n.split() if t in m.split()), 9)
            if got / sum(1 / df[t] for t in n.split()) >= resolve.RECALL:
                scores[n] = got
        top = [n for n, got in scores.items() if got == max(scores.values())]
        whole = [n for n in top if set(n.split()) <= set(m.split())]
        want[m] = (top[0], False) if len(top) == 1 else (whole[0], False) if len(whole) == 1 else (None, bool(top))
    frames = [spark.createDataFrame([(x,) for x in rows], f"{column} string") for rows, column in ((said, "mention"), (names, "name"))]
    got = {r["mention"]: (r["name"], r["ambiguous"]) for r in resolve.resolve(*frames).collect()}
    assert got["the a3 b4 c5 people"] == ("a3 b4 c5", False)
    assert got == want


def test_batch_and_question_agree(spark):
    """Last words of names within other words: the joins and the index of one question give the same name, or the same refusal."""
    pick = random.Random(11)
    names = sorted({f"{pick.choice('NSEW')}orth{pick.randint(0, 30)} {pick.choice(['water', 'road', 'power', 'metro'])} {pick.choice(['board', 'works', 'rail'])} unit{pick.randint(0, 400)}" for _ in range(600)})
    index, said = NameIndex(tuple(names)), set()
    for n in names:
        ws = n.lower().split()
        said.add(f"please show {' '.join(ws[pick.randint(0, 3) :])} then")
    frames = [spark.createDataFrame([(x,) for x in rows], f"{column} string") for rows, column in ((sorted(said), "mention"), (names, "name"))]
    got = {r["mention"]: (r["name"], r["ambiguous"]) for r in resolve.resolve(*frames).collect()}
    want = {m: index.find(m) for m in said}
    assert got == {m: (f.name, f.ambiguous) for m, f in want.items()}
    assert {a for _, a in got.values()} == {True, False} and len(got) > 400


def test_names_are_read_once(spark, tmp_path):
    names = spark.createDataFrame([("North Water Board",), ("City Metro Rail",)], "name string")
    names.write.parquet(str(tmp_path / "names"))
    plan = resolve.resolve(names.select(F.col("name").alias("mention")), spark.read.parquet(str(tmp_path / "names")))._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and plan.count("Scan ExistingRDD") < 20


VOCABULARY = Vocabulary.of("work", {"category": ["road", "dam"], "state": ["Kerala", "Goa"]})


@pytest.mark.parametrize(("question", "want"), [
    ("What is the total value of road works in Kerala?", ("sum", "value", (("category", "eq", "road"), ("state", "eq", "Kerala")), None)),
    ("How many works in 2003 were not dam?", ("count", None, (("category", "ne", "dam"), ("year", "eq", 2003)), None)),
    ("Average size of projects above 20 crore", ("mean", "value", (("value", "gte", 200_000_000),), None)),
    ("By how much did the total value of works change between 2001 and 2003?", ("sum", "value", (), "delta")),
    ("What share of the value of works is road?", ("sum", "value", (("category", "eq", "road"),), "ratio")),
    ("What is the capital of France?", None), ("Tell me about works", None), ("total value of road and dam works", ("sum", "value", (("category", "in", ("road", "dam")),), None)), ("total value of road works in dam", None),
])
def test_compile(question, want):
    plan = compile_question(question, VOCABULARY).plan
    assert (plan and (plan.fn, plan.field, plan.filters, plan.op)) == want


REWORDINGS = [str.upper, lambda q: f"Please tell us: {q}", lambda q: q.replace("?", ""), lambda q: q.replace(" ", "  "), lambda q: f"{q} Thank you."]


@pytest.mark.parametrize("reword", REWORDINGS)
def test_rewording_keeps_the_plan(reword):
    for q in ("What is the total value of road works in Kerala?", "How many works in 2003 were not dam?"):
        assert compile_question(reword(q), VOCABULARY).plan == compile_question(q, VOCABULARY).plan


ROWS = [{"qid": "a", "question": "x?", "answer": 1}, {"question": "no id"}, {"id": "b", "text": "y?", "unit": "count"}]


@pytest.mark.parametrize("raw", [
    json.dumps(ROWS).encode(), json.dumps({"questions": ROWS}).encode(), json.dumps({"data": ROWS}).encode("utf-8-sig"), json.dumps(ROWS).encode("utf-16"),
    "\r\n".join(json.dumps(r) for r in ROWS).encode() + b"\r\n{broken\r\n",
])
def test_question_envelopes(raw):
    assert readers.parse_questions(raw) == [("a", "x?", None, 1.0), ("b", "y?", "count", None)]


def test_question_file_and_answers(spark, tmp_path):
    (tmp_path / "q.json").write_bytes(json.dumps(ROWS).encode())
    assert readers.load_questions(spark, str(tmp_path / "q.json")).count() == 2
    with pytest.raises(ValueError):
        readers.parse_questions(b"[]")
    assert readers.submission_text([("a", 5.0), ("b", 2.5), ("c", None)]) == "question_id,answer\na,5\nb,2.5\nc,\n"
    two = spark.createDataFrame([("a", 5.0), ("b", 2.5)], "qid string, answer double")
    readers.write_answers(two, f"{tmp_path}/out")
    with pytest.raises(ValueError):
        readers.write_answers(two.limit(1), f"{tmp_path}/out")
    assert {tuple(r) for r in spark.read.csv(f"{tmp_path}/out", header=True).collect()} == {("a", "5"), ("b", "2.5")}


def test_files(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "B.txt").write_text("b")
    (tmp_path / "in" / "deep" / "A.txt").write_text("a")
    (tmp_path / "in" / "s.csv").write_text("n,,v\n1,,x\n,,\nTOTAL,,y\n")
    files = readers.walk(spark, str(tmp_path / "in"), "*.txt")
    assert [r["doc_id"] for r in files.collect()] == ["A", "B"]
    assert readers.find(files, "B").first()["name"] == "B.txt"
    assert readers.sheet(spark, str(tmp_path / "in" / "s.csv")).columns == ["n", "v"]
    (tmp_path / "in" / "Contract_7.csv").write_text("n\n1\n")
    named = readers.keyed_by_file(spark.read.csv(str(tmp_path / "in" / "Contract_7.csv"), header=True), r"Contract_(\d+)", "contract")
    assert [tuple(r) for r in named.collect()] == [("1", "7")]
    texts = spark.createDataFrame([("a", "x"), ("b", "y")], "doc_id string, text string")
    assert readers.cached(texts.limit(1), f"{tmp_path}/cache").count() == 1
    assert readers.cached(texts, f"{tmp_path}/cache").count() == 2
    assert {(r["table"], r["rows"]) for r in readers.catalog({"t": texts, "u": texts.limit(1)}).collect()} == {("t", 2), ("u", 1)}


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    events.limit(50).write.mode("append").parquet(f"{tmp_path}/in")  # repeated ones count once
    stream = balances.windowed_balances(balances.read_events(spark, f"{tmp_path}/in", events.schema.simpleString()[7:-1].replace(":", " "), 10), late="60 days")
    q = stream.writeStream.format("memory").queryName("balances").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["event_type"], r["window_start"]): (r["n"], r["amount"]) for r in spark.sql("select * from balances").collect()}
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    want = events.groupBy("event_type", day.alias("d")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("a")).collect()
    assert got == {(r["event_type"], r["d"]): (r["n"], r["a"]) for r in want}


def test_sessions_end_at_gaps(spark):
    rows = [(1, 7, "2020-01-01 10:00:00"), (2, 7, "2020-01-01 10:20:00"), (3, 7, "2020-01-01 11:00:00"), (4, 8, "2020-01-01 10:00:00")]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts string")
    got = {(r["user_id"], str(r["session_start"])): r["n"] for r in balances.sessions(events).collect()}
    assert got == {(7, "2020-01-01 10:00:00"): 2, (7, "2020-01-01 11:00:00"): 1, (8, "2020-01-01 10:00:00"): 1}


def test_a_word_of_all_names_is_asked_nowhere(spark):
    """Every name holds one word and every mention says it: what is asked grows with the mentions, not with names times mentions."""
    size = 20_000
    names = spark.range(size).select(F.format_string("Customer#%09d", "id").alias("name"))
    said = names.select(F.concat(F.lit("the "), F.lower("name"), F.lit(" people")).alias("mention"))
    asked, met = [], resolve._met
    try:
        resolve._met = lambda a, k: asked.append(met(a, k)) or asked[-1]
        found = resolve.resolve(said, names)
    finally:
        resolve._met = met
    assert asked[0].count() == size
    assert found.filter(F.col("mention") == F.concat(F.lit("the "), F.lower("name"), F.lit(" people"))).count() == size
    assert "customer" not in {r["t"] for r in asked[0].select("t").distinct().limit(size).collect()}


def test_contained_mentions_are_asked_under_their_rarest_word(spark):
    """Said words that stand in one name alone, in several, and beside a word that no name holds."""
    names = spark.createDataFrame([(f"Water Board Unit{k} of Region{k % 3} with many more words each{k} other{k}",) for k in range(300)], "name string")
    said = spark.createDataFrame([("our water board unit7",), ("the water board",), ("water board unit7 nowhere",), ("water unit7 region2",), ("water unit7 region1",)], "mention string")
    got = {r["mention"]: (r["name"], r["ambiguous"]) for r in resolve.resolve(said, names).collect()}
    seven = "Water Board Unit7 of Region1 with many more words each7 other7"
    assert got["our water board unit7"] == (seven, False) and got["the water board"] == (None, True) and got["water unit7 region1"] == (seven, False)
    asked, met = [], resolve._met
    try:
        resolve._met = lambda a, k: asked.append(met(a, k)) or asked[-1]
        resolve.resolve(spark.createDataFrame([("water board each7",)], "mention string"), names).collect()
    finally:
        resolve._met = met
    assert asked[-1].count() <= 1
