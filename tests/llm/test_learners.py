"""Fitted operators: held-out accuracy, odd rows, no labels; and the pipeline against plain Python."""

import re
import zlib

import numpy as np
import pytest

from tessera.llm import langid, quality, quality_rules, queries, secrets, toxicity

DIR = "/root/testdata/sf0.01"


def joined(spark, df, column):
    labels = spark.read.parquet(f"{DIR}/{'labels' if column != 'lang' else 'documents'}.parquet").select("doc_id", column)
    return df.join(labels, "doc_id").filter("held_out").collect()


def test_quality(spark):
    df = queries.op1_quality(spark, DIR)
    assert df.columns == ["doc_id", "held_out", "score", "predicted"] and df.count() == 1000
    for r in df.collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    rows = joined(spark, df, "quality")
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.93


def test_language(spark):
    df = queries.op3_language(spark, DIR)
    assert df.count() == 1000
    for r in df.collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    assert np.mean([r["lang_pred"] == r["lang"] for r in joined(spark, df, "lang")]) > 0.98


def test_toxicity(spark):
    df = queries.op5_toxicity(spark, DIR)
    assert df.count() == 1000 and df.filter("score between 0 and 1").count() == 1000
    rows = joined(spark, df, "toxic")
    caught = sum(r["predicted"] and r["toxic"] for r in rows)
    # a quarter to a third of the toxic rows hold no word that tells them from the others
    assert caught >= 0.6 * sum(r["toxic"] for r in rows) > 0 and caught >= 0.9 * sum(r["predicted"] for r in rows)


def test_toxicity_learns_a_planted_word():
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 500, 40)) + (" vile" if i % 5 == 0 else "") for i in range(600)]
    model = toxicity.ftrl([(np.unique(toxicity.coordinates(t)).astype(np.int64), int(i % 5 == 0)) for i, t in enumerate(texts)])
    assert model.score("some vile words") > 0.5 > model.score("some other words")
    assert len(model.where) < 200


def small(spark, *columns):
    docs = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    labels = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    return docs, labels


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def plain_statistics(text):
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * quality.STATS
    kinds = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "#*$%&", "|<>{}[]\\_=~^", "!?", ".,;:", None, " \t\n\v\f\r"]
    shares = [sum(c >= 128 if k is None else chr(c) in k for c in raw) / len(raw) for k in kinds]
    lines = [x for x in raw.split(b"\n") if x]
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    log = lambda x: float(np.log(1 + x))
    return shares + [
        log(len(words)), log(len(raw) / len(words)), log(max(map(len, words))), len(set(words)) / len(words) ** 0.8, 1 - len(set(triples)) / len(triples) if triples else 0.0,
        1 - len(set(lines)) / len(lines), log(len(raw) / len(lines)), words.count(b"|") / len(words), sum(len(x) <= 2 for x in words) / len(words),
    ]


def test_quality_against_plain_numpy(spark):
    """All rows in one matrix: least squares on the stacked ridge system, isotonic means by the max-min formula."""
    docs, labels = small(spark)
    ids = sorted(docs)
    x = np.array([plain_statistics(docs[i]["text"]) for i in ids])
    y = np.array([labels[i]["quality"] if i in labels and labels[i]["quality"] is not None and remainder(i, 5) else np.nan for i in ids], float)
    learned = ~np.isnan(y)
    z = np.clip((x - x[learned].mean(0)) / np.maximum(x[learned].std(0), 1e-3), -6, 6)
    rng = np.random.default_rng(11)
    w, b = rng.normal(0, 1 / np.sqrt(quality.STATS), (quality.STATS, quality.FEATURES)), rng.uniform(0, 2 * np.pi, quality.FEATURES)
    f = np.column_stack([np.sqrt(2 / quality.FEATURES) * np.cos(z @ w + b), np.ones(len(z))])
    fit = learned & np.array([remainder(i, 5) != 4 for i in ids])
    ridge = np.diag(np.sqrt([quality.RIDGE] * quality.FEATURES + [1e-6]))
    beta = np.linalg.lstsq(np.vstack([f[fit], ridge]), np.r_[y[fit], np.zeros(len(ridge))], rcond=None)[0]
    raw = f @ beta
    place = np.clip((raw - quality.LOW) / (quality.HIGH - quality.LOW) * quality.BINS, 0, quality.BINS - 1).astype(int)
    held = learned & ~fit
    bins = sorted(set(place[held]))
    n = np.array([(place[held] == k).sum() for k in bins], float)
    s = np.array([y[held][place[held] == k].sum() for k in bins])
    n, s = n + 0.02, s + 0.02 * y[held].mean()
    mean = lambda a, b: s[a : b + 1].sum() / n[a : b + 1].sum()
    steps = [max(min(mean(a, b) for b in range(i, len(bins))) for a in range(i + 1)) for i in range(len(bins))]
    want = np.clip(np.interp(raw, [quality.LOW + (k + 0.5) / quality.BINS * (quality.HIGH - quality.LOW) for k in bins], steps), 0, 1)
    got = {r["doc_id"]: r["score"] for r in queries.op1_quality(spark, "/root/testdata/sf0.001").collect()}
    assert [got[i] for i in ids] == pytest.approx(want.tolist(), abs=1e-6)


def plain_trigrams(text):
    raw = f" {text.lower()} ".encode()
    for a, b, c in zip(raw, raw[1:], raw[2:], strict=False):
        h = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) % 2**32
        yield (h ^ h >> 15) * 0x2C1B3C6D % 2**32 >> 19


def test_language_against_plain_python(spark):
    """Counts in dictionaries; every bit, margin and loss in a loop of its own."""
    docs, _ = small(spark)
    counts: dict = {}
    for i, r in docs.items():
        if r["lang"] is not None and remainder(i, 4) != 2 and re.search(r"[^\W\d_]", r["text"] or ""):
            for t in plain_trigrams(r["text"]):
                of = counts.setdefault(r["lang"], {})
                of[t] = of.get(t, 0) + 1
    names, slots = sorted(counts), range(langid.SLOTS)
    total = {x: sum(counts[x].values()) + 0.5 * langid.SLOTS for x in names}
    p = {x: [(counts[x].get(t, 0) + 0.5) / total[x] for t in slots] for x in names}
    code = langid.codewords(len(names)).tolist()
    bits = range(len(code[0]))
    weights, sure = [], [[0.0] * len(bits) for _ in names]
    for k in bits:
        side = lambda sign: [names[c] for c in range(len(names)) if code[c][k] == sign]  # noqa: E731, B023
        w = [np.log(np.mean([p[x][t] for x in side(1)]) / np.mean([p[x][t] for x in side(-1)])) for t in slots]
        usual = [sum(p[x][t] * w[t] for t in slots) for x in names]
        scale = max(np.mean(np.abs(usual)), 1e-9)
        weights.append([v / scale for v in w])
        for c in range(len(names)):
            sure[c][k] = max(usual[c] / scale * code[c][k], 1e-6)
    trust = [[v / sum(row) for v in row] for row in sure]
    got = {r["doc_id"]: r for r in queries.op3_language(spark, "/root/testdata/sf0.001").collect()}
    for i in sorted(docs)[::4]:
        text = docs[i]["text"]
        if not re.search(r"[^\W\d_]", text or ""):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0)
            continue
        seen = list(plain_trigrams(text))
        margin = [sum(weights[k][t] for t in seen) / len(seen) for k in bits]
        loss = [sum(trust[c][k] * np.log1p(np.exp(-2 * code[c][k] * margin[k])) for k in bits) for c in range(len(names))]
        near = [np.exp(-langid.SHARPNESS * (v - min(loss))) for v in loss]
        assert got[i]["lang_pred"] == names[int(np.argmin(loss))]
        assert got[i]["score"] == pytest.approx(max(near) / sum(near), abs=1e-4)  # weights are floats of 32 bits


def test_too_many_labels_are_no_languages(spark):
    docs = spark.createDataFrame([(i, "some words", f"l{i}") for i in range(20)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="different labels"):
        langid.learn(docs, max_languages=10)
    assert len(langid.learn(docs, max_languages=20).languages) == 20


def test_toxicity_against_plain_python(spark):
    """FTRL-proximal over dictionaries, one coordinate at a time."""
    docs, labels = small(spark)
    order = spark.createDataFrame([(i,) for i in docs], "doc_id long").selectExpr("doc_id", "xxhash64(doc_id) p").orderBy("p", "doc_id").collect()
    rows = [(sorted(set(toxicity.coordinates(docs[r["doc_id"]]["text"]).tolist())), labels[r["doc_id"]]["toxic"]) for r in order
            if r["doc_id"] in labels and labels[r["doc_id"]]["toxic"] is not None and remainder(r["doc_id"], 4) != 2]
    often: dict = {}
    for at, _ in rows:
        for k in at:
            often[k] = often.get(k, 0) + 1
    z, n = {}, {}

    def weight(k):
        l1 = 0 if k == "bias" else toxicity.L1
        zk = z.get(k, 0.0)
        return 0.0 if abs(zk) <= l1 else -(zk - np.sign(zk) * l1) / ((toxicity.BETA + n.get(k, 0.0) ** 0.5) / toxicity.ALPHA + toxicity.L2)

    def say(at):
        return 1 / (1 + np.exp(-np.clip(sum(map(weight, at)) + weight("bias"), -35, 35)))

    for _ in range(toxicity.EPOCHS):
        for at, y in rows:
            at = [k for k in at if often[k] >= toxicity.RARE]
            g = say(at) - y
            for k in [*at, "bias"]:
                old = n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - ((old + g * g) ** 0.5 - old ** 0.5) / toxicity.ALPHA * weight(k)
                n[k] = old + g * g
    got = {r["doc_id"]: r["score"] for r in queries.op5_toxicity(spark, "/root/testdata/sf0.001").collect()}
    for i, r in docs.items():
        assert got[i] == pytest.approx(say(sorted(k for k in set(toxicity.coordinates(r["text"]).tolist()) if k in z)), abs=1e-5)


def test_toxicity_bounds(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(50 if i else 5000))) for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    seen = []
    keep, toxicity.ftrl = toxicity.ftrl, lambda rows, epochs: seen.append(rows) or keep(rows, epochs)
    try:
        toxicity.learn(docs, labels, max_rows=10)
        toxicity.learn(docs, labels, max_coordinates=1000)
        toxicity.learn(docs, labels)
    finally:
        toxicity.ftrl = keep
    assert [len(rows) for rows in seen] == [10, 6, 20]
    assert sum(len(at) for at, _ in seen[1]) <= 1000


def test_codewords_and_isotonic():
    for k in (2, 4, 7, 12):
        code = langid.codewords(k)
        apart = [(code[a] != code[b]).sum() for a in range(k) for b in range(a)]
        assert min(apart) >= max(1, code.shape[1] // 4)
    assert quality.pool_adjacent_violators(np.ones(5), np.array([0, 1, 0, 1, 1.0])).tolist() == [0, 0.5, 0.5, 1, 1]


def test_odd_rows(spark, odd_docs, no_docs):
    model = langid.learn(odd_docs)
    rows = langid.identify(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (0, 1, 2)} == {"und"} and all(r["score"] == 0 for r in rows if r["lang_pred"] == "und")
    assert langid.accepted(odd_docs, model).columns == odd_docs.columns
    assert langid.identify(no_docs, model).count() == 0 and langid.accepted(no_docs, model).count() == 0
    clashing = odd_docs.withColumnsRenamed({"score": "lang_pred", "piece": "ambiguous"})
    assert sorted(map(str, langid.identify(clashing, model).collect())) == sorted(map(str, rows))
    nothing = langid.learn(no_docs)
    assert {r["lang_pred"] for r in langid.identify(odd_docs, nothing).collect()} == {"und"}
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (3, None, None), (5, 0, 1), (5, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for some in (labels, none):
        fitted = quality.learn(quality.document_statistics(odd_docs), some)
        out = quality.score(quality.document_statistics(odd_docs), fitted)
        assert out.filter("score between 0 and 1").count() == odd_docs.count()
        out = toxicity.score(odd_docs, toxicity.learn(odd_docs, some))
        assert out.filter("score between 0 and 1").count() == odd_docs.count()
        assert quality.document_statistics(no_docs).count() == 0 and toxicity.score(no_docs, toxicity.learn(no_docs, some)).count() == 0


UNKNOWN = [
    "日本の首都は東京であり、多くの人々がこの都市で働き、暮らしている。春には桜が咲き、公園は花見の客でにぎわう。",
    "Москва является столицей России. Каждый день миллионы людей едут на работу в метро, читают книги и слушают музыку.",
    "القاهرة هي عاصمة مصر وأكبر مدنها ويعيش فيها ملايين الناس الذين يعملون كل يوم في الأسواق والمكاتب",
    "Helsinki on Suomen pääkaupunki ja sen suurin kaupunki. Joka päivä tuhannet ihmiset kulkevat töihin junalla ja lukevat kirjoja.",
    "Ankara Türkiye'nin başkentidir ve her gün binlerce insan işe gitmek için otobüse biner, kitap okur ve müzik dinler.",
    "kqz vxw jjq zpfk wqx bzv hxk qqj vkz xwp mzq jxv kpq zzw fqk vbx qjz xkw pvq zfx wkj qvz",
    "3q2+7wAAAEVx9sKfQzJ8bXkPLm0Vd4hTn1c5YwRgU6aZoBiEjFvHsMtNyOxQpSrCuDlGkWA8e7f6d5c4b3a2",
    "static int parse(struct node *n, char **p) { for (int i = 0; i < n->len; i++) { if (p[i] == NULL) return -1; n->buf[i] = *p[i]; } return 0; }",
    "12345 67890 !!!",
]


def test_language_stage_drops_unknown_and_keeps_mixed(spark):
    """Foreign and junk texts go, all known ones stay, mixed ones and ones full of numbers too."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.learn(docs)
    firsts = {r["lang"]: r["text"] for r in docs.filter("length(text) between 300 and 2000").orderBy("doc_id").collect()}
    names = sorted(firsts)
    mixed = [firsts[a][:300] + " " + firsts[b][:300] for a in names for b in names if a < b] + [" ".join(firsts[a][:200] for a in names)]
    mixed.append(firsts["de"][:60] + ' 7844238401328224 token = "b64b244acde2e3b0aa8f051af1ec018ebaba3add" +1 (545) 555-9193')
    planted = [(10**6 + i, t, None) for i, t in enumerate(UNKNOWN)] + [(2 * 10**6 + i, t, None) for i, t in enumerate(mixed)]
    out = {r["doc_id"] for r in langid.accepted(docs.unionByName(spark.createDataFrame(planted, docs.schema)), model).collect()}
    assert [t for i, t in enumerate(UNKNOWN) if 10**6 + i in out] == []
    assert [t for i, t in enumerate(mixed) if 2 * 10**6 + i not in out] == []
    assert len(out) == docs.count() + len(mixed)
    one = langid.learn(docs.filter("lang = 'en'"))
    assert one.fit(firsts["en"]) > 0.5 > max(map(one.fit, UNKNOWN))


def test_language_stage_decodes_by_output_codes(spark, pipeline, monkeypatch):
    """Codewords decide: without the check behind them all texts of known languages stay, without codewords or check none does."""
    from dataclasses import replace

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    model = langid.learn(docs)
    alone = replace(model, familiar=np.zeros(langid.SLOTS))
    silent = replace(alone, weights=np.zeros_like(model.weights))
    stage = lambda m: (monkeypatch.setattr(langid, "learn", lambda rows: m), pipeline.language_stage(spark, docs, DIR))[1]
    assert stage(alone).count() == docs.filter("text rlike '[A-Za-z]'").count() > 0 and stage(silent).count() == 0
    assert [t for t in UNKNOWN if alone.known(t) or model.known(t)] == []


@pytest.fixture(scope="module")
def pipeline():
    import corpus_pipeline

    return corpus_pipeline


def test_pipeline_stages(spark, pipeline, odd_docs, no_docs):
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "language_id", "ngram_join", "secret_scan", "packing"]
    for docs in (odd_docs.select("doc_id", "text", "lang", "source", "n_chars"), no_docs.select("doc_id", "text", "lang", "source", "n_chars")):
        for _, stage in pipeline.STAGES[:-1]:
            out = stage(spark, docs, DIR)
            assert out.columns == docs.columns and out.count() <= docs.count()
        assert pipeline.STAGES[-1][1](spark, docs, DIR).count() >= docs.count()


def plain_kept(docs):
    """Ids that pass the base rules and their group's fences, with exact quartiles."""
    from .test_texts import WORD, plain_rules

    ratios, groups = {}, {}
    for r in docs:
        n, chars, symbols, dup, repeat = plain_rules(r["text"])
        lines = [x for x in (r["text"] or "").split("\n") if WORD.search(x)]
        if n >= 10 and 100 * repeat <= 20 * n:
            ratios[r["doc_id"]] = (symbols / max(n, 1), dup / max(len(lines), 1), repeat / max(n, 1), chars / max(n, 1))
            for key in ((r["lang"], r["source"]), (r["lang"],), ()):
                groups.setdefault(key, []).append(ratios[r["doc_id"]])
    out = set()
    for r in docs:
        if r["doc_id"] not in ratios:
            continue
        group = next(g for key in ((r["lang"], r["source"]), (r["lang"],), ()) if len(g := groups[key]) >= quality_rules.LEAST or not key)
        for value, column, (least, both) in zip(ratios[r["doc_id"]], zip(*group, strict=True), quality_rules.RATIOS.values(), strict=True):
            ranked = sorted(column)
            low, high = (ranked[-(-len(ranked) * q // 4) - 1] for q in (1, 3))
            fence = quality_rules.FENCE * max(high - low, least)
            if value > high + fence or both and value < low - fence:
                break
        else:
            out.add(r["doc_id"])
    return out


def test_pipeline_against_plain_python(spark, pipeline):
    """Each stage on all that its predecessor kept, once more in plain Python."""
    from .conftest import plain_components
    from .test_texts import TOKENIZER, plain_spans

    small = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{small}/documents.parquet").collect()
    docs = {r["doc_id"]: r["text"] for r in rows}
    passed = plain_kept(rows)
    kept = {i: t for i, t in docs.items() if i in passed}
    langs = {r["doc_id"]: r["lang"] for r in rows}
    counts: dict = {}
    for i, t in kept.items():
        if langs[i] is not None and re.search(r"[^\W\d_]", t):
            counts[langs[i]] = counts.get(langs[i], 0) + langid.trigram_counts(t)
    model = langid.LanguageModel.from_counts(counts)
    kept = {i: t for i, t in kept.items() if model.fit(t) >= langid.LEAST_FIT}
    classes = plain_components(list(kept.items()))
    kept = {i: t for i, t in kept.items() if classes[i][1] == i}
    pieces = pipeline.run(spark, small).collect()
    assert {r["doc_id"] for r in pieces} == set(kept) and len(kept) < len(docs)
    places, by_doc = {}, {}
    for r in pieces:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for spans in places.values():  # gapless from 0, none beyond the capacity
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    lengths = [r["length"] for r in pieces]
    from .test_texts import first_fit_decreasing

    assert len(places) <= first_fit_decreasing(lengths, 4096) + 1
    for i, t in kept.items():
        if plain_spans(t) or secrets.find_spans(t)[1]:
            t = secrets.redact(t, secrets.find_spans(t)[1])
        ids = [*TOKENIZER.encode(t, add_special_tokens=False).ids, 1]
        for piece, r in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            part = ids[4096 * piece : 4096 * (piece + 1)]
            assert (r["piece"], r["start"], r["length"], r["ids_crc32"]) == (piece, 4096 * piece, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
        assert len(by_doc[i]) == -(-len(ids) // 4096)
