"""Operators that look at one text at a time."""

import hashlib
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import html, media, packing, pieces, quality_rules, secrets

from .conftest import ODD, WORD

MODEL, VOCABULARY = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
SP, TOKENIZER = sentencepiece.SentencePieceProcessor(model_file=MODEL), Tokenizer.from_file(VOCABULARY)
TEXTS = st.text(st.sampled_from("ab ▁\n\té漢😀\x00.,'-01thein<s>|Ḱİ"), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_pieces_equal_the_library(text):
    m = pieces.model(MODEL)
    want = SP.encode(text)
    assert m.encode(text) == want
    assert m.decode(want) == SP.decode(want)
    assert m.digest(text) == (len(want), ",".join(map(str, want)), SP.decode(want))


def test_pieces_of_odd_and_real_texts(spark, odd_docs, no_docs):
    rows = {r["doc_id"]: r for r in pieces.encode_digest(odd_docs, MODEL).filter("doc_id is not null").collect()}
    for i, t in enumerate(ODD):
        ids = SP.encode(t or "")
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256(SP.decode(ids).encode()).hexdigest()
    assert pieces.encode_digest(no_docs, MODEL).count() == 0
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in real.collect()}
    for r in pieces.encode_ids(real, MODEL).collect():
        assert r["ids"] == SP.encode(texts[r["doc_id"]]) and r["decoded"] == SP.decode(r["ids"])


def test_small_cache_gives_the_same(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_SEGMENTS", 3)
    m = pieces.PieceModel(MODEL)
    text = "one two 漢字 three four. five, é漢 six one two" * 3
    assert m.digest(text) == (len(SP.encode(text)), ",".join(map(str, SP.encode(text))), SP.decode(SP.encode(text)))


def test_segments_with_odd_characters_go_through_backtracking(monkeypatch):
    """Merging never sees a whole segment around a character without a piece; ids equal the library's."""
    m, seen = pieces.PieceModel(MODEL), []
    merge = m.merge
    monkeypatch.setattr(m, "merge", lambda chars: seen.append(chars) or merge(chars))
    for text in ("some\nother words\n\nstand here", "\n", "\nx\n", "unbelievable𓀀𓀁thinking", "𓀀𓀁𓀂 ☃\n" * 5):
        assert m.encode(text) == SP.encode(text)
    assert [chars for chars in seen if not m.covered.issuperset(chars)] == []


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_ids_equal_the_tokenizer(text):
    (raw,) = packing.encode_texts([text], VOCABULARY)
    assert np.frombuffer(raw, "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def bins_used(lengths, capacity=40):
    """Number of bins after checking that every place is whole and gapless."""
    bins, offsets = packing.best_two_fit(lengths, capacity)
    used = {}
    for b, o, n in sorted(zip(bins, offsets, lengths, strict=True)):
        assert used.get(b, 0) == o
        used[b] = o + n
    assert all(v <= capacity for v in used.values())
    return len(used)


def fewest_bins(lengths, capacity=40):
    """The optimum, by trying every bin for every length."""
    lengths = sorted(lengths, reverse=True)

    def fits(k, room):
        return k == len(lengths) or any(
            fits(k + 1, [*room[:i], room[i] - lengths[k], *room[i + 1 :]]) for i in {r: i for i, r in enumerate(room)}.values() if room[i] >= lengths[k]
        )

    return next(n for n in range(len(lengths) + 1) if fits(0, [capacity] * n))


def first_fit_decreasing(lengths, capacity=40):
    room = []
    for n in sorted(lengths, reverse=True):
        at = next((i for i, r in enumerate(room) if r >= n), None)
        if at is None:
            room.append(capacity - n)
        else:
            room[at] -= n
    return len(room)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=8))
def test_few_bins_against_the_optimum(lengths):
    assert bins_used(lengths) <= (11 * fewest_bins(lengths) + 6) / 9


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=20, max_size=200))
def test_many_bins_against_first_fit(lengths):
    assert bins_used(lengths) <= first_fit_decreasing(lengths) + 1


def test_two_fit_exchange():
    """10 + 6 leaves 4 of 20; instead of the 6 the pair 5 + 5 fills it."""
    bins, _ = packing.best_two_fit([10, 7, 5, 5], 20)
    assert bins[0] == bins[2] == bins[3] != bins[1]


def test_packing(spark, odd_docs, no_docs):
    out = packing.pack(odd_docs, VOCABULARY, capacity=64, shard_pieces=10).collect()
    real = {i: [*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(ODD)}
    by_doc, by_bin = {}, {}
    for r in out:
        by_bin.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        if r["doc_id"] is not None and r["doc_id"] != 5:
            by_doc.setdefault(r["doc_id"], []).append(r)
    for i, rows in by_doc.items():
        rows.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in rows] == list(range(len(rows))) and sum(r["length"] for r in rows) == len(real[i])
        for r in rows:
            part = real[i][r["start"] : r["start"] + r["length"]]
            assert r["length"] == min(64, len(real[i]) - r["start"]) and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    for places in by_bin.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(r["doc_id"] == 5 for r in out) == 2
    assert packing.pack(no_docs, VOCABULARY).count() == 0


def test_media_round_trip(odd_docs, no_docs):
    rows = {r["doc_id"]: r for r in media.media_digest(odd_docs).filter("doc_id is not null").collect()}
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        size = max(64, -(-len(raw) // 64) * 64)
        payload, r = raw.ljust(size, b"\0"), rows[i]
        stored = media.store_samples(payload)
        assert media.read_samples(stored) == payload
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert media.media_digest(no_docs).count() == 0


def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


GIF = b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"
JPEG = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x05\x08\0\x01\xff\xda\0\x03\x01data\xff\x00x\xff\xd9"
BMP = b"BM" + struct.pack("<IIIIiiHH", 58, 0, 54, 40, 1, 1, 1, 24) + b"\0" * 24 + b"\0" * 4


@pytest.mark.parametrize(("blob", "kind"), [(png(), "image/png"), (GIF, "image/gif"), (JPEG, "image/jpeg"), (BMP, "image/bmp"), (media.store_samples(b"12345"), "audio/wav")])
def test_sniffing(blob, kind):
    assert media.true_type(blob, "text/plain") == (kind, True, [])
    assert media.true_type(blob, kind)[1] is False
    assert media.sniff(b"junk" + blob + b"tail" + blob) == [(kind, 4, len(blob)), (kind, 8 + len(blob), len(blob))]
    assert media.sniff(blob[: len(blob) // 2]) == []


def test_bombs_and_repeated_magic():
    import gzip
    import resource

    bomb = gzip.compress(bytes(300_000_000), 9)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert media.sniff(b"junk" + bomb + b"tail") == [("application/gzip", 4, len(bomb))]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 50_000  # KB
    for n in (0, 1, 70_000, 131_072):
        packed = gzip.compress(np.random.default_rng(n).bytes(n))
        assert media.sniff(packed + b"x" * n) == [("application/gzip", 0, len(packed))]
        assert media.sniff(packed[:-1]) == []
    assert media.sniff(b"%PDF-" * 60_000) == media.sniff(b"%PDF-" * 60_000 + b"%%EOF") == []
    pdf = b"%PDF-1.4 1 0 obj startxref 0 %%EOF"
    assert media.sniff(b"%PDF- " + pdf + b" " + pdf)[-1] == ("application/pdf", 7 + len(pdf), len(pdf))


def test_sniffing_rejects_look_alikes(spark):
    assert media.true_type(b"BM is no bitmap, RIFF no wave, %PDF- no document", "text/plain")[0] == "unknown"
    broken = bytearray(png())
    broken[-20] ^= 1
    assert media.sniff(bytes(broken)) == []
    df = spark.createDataFrame([("a", bytearray(b"xx" + GIF), "image/png"), ("b", None, None), (None, bytearray(GIF), None)], "k string, b binary, t string")
    rows = {r["id"]: r for r in media.sniff_media(df, id_col="k", blob_col="b", declared_col="t").collect()}
    assert rows["a"]["embedded"][0]["content"] == GIF and rows["b"]["media_type"] == "empty" and rows[None]["media_type"] == "image/gif"


BASE = {
    "assign": (re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[1]) >= 8),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16), "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
}


def plain_spans(text):
    found = [(m.start(), list(BASE).index(k), f"{k}:{m.start()}:{m.end()}") for k, (p, ok) in BASE.items() for m in p.finditer(text or "") if ok(m)]
    return [x for *_, x in sorted(found)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "Token", "API_key", "apikey", "secret", ":", "=", " ", '"', "abc", "deadbeef" * 4, "AKIA", "ABCDEF123456", "short", "longvalue1", "\n\n", "é", "user: bob", "https://x.example.com/a"]), max_size=14).map("".join))
def test_base_spans(text):
    base, spans = secrets.find_spans(text)
    assert [f"{k}:{a}:{b}" for k, a, b in base] == plain_spans(text)
    assert set(base) <= set(spans)


def test_weak_parts_need_a_complement():
    key = "Zk3xQ9vLm2Tt7Rb8Wc1Yp4Hd"
    assert secrets.find_spans(f"the build is {key} today")[1] == []
    assert secrets.find_spans("client_id: alpha-7 was seen")[1] == []
    assert {s.kind for s in secrets.find_spans(f"client_id: alpha-7 {key}")[1]} == {"ident", "token"}
    assert {s.kind for s in secrets.find_spans(f"https://db.example.com/x\n{key}")[1]} == {"endpoint", "token"}
    assert secrets.find_spans(f"client_id: alpha-7\n\n{key}")[1] == []
    assert secrets.find_spans(f"client_id: alpha-7 {'word ' * 60}{key}")[1] == []
    assert secrets.redact(f"a {key} b", [secrets.Span("token", 2, 2 + len(key))]) == "a [secret] b"


def plain_links(text, base, weak):
    """Weak spans with a complement, by trying all pairs."""
    secretive = ("assign", "hex", "token")
    good = set()
    for a in weak:
        for b in [*base, *weak]:
            first, second = sorted((a, b), key=lambda s: s.start)
            near = second.start - first.end <= 2 * secrets.SCOPE and second.start >= first.end
            if near and (a.kind in secretive) != (b.kind in secretive) and "\n\n" not in text[first.end : second.start]:
                good.add(a)
    return good


LINKABLE = ["password=", "longvalue1", "deadbeef" * 4, "AKIA" + "B2" * 8, " ", "\n", "\n\n", "client_id: alpha-7", "user: bob", "https://db.example.com/Ab1/x", "db.example.com:5432",
            "Zk3xQ9vLm2Tt7Rb8Wc1Yp4Hd", "https://docs.example.com/Pages/AbCdEf1234567890GhIjKl", "user: Zk3xQ9vLm2Tt7Rb8Wc1Yp4Hd", "word " * 20, "é漢"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(LINKABLE), max_size=16).map(" ".join))
def test_links_equal_all_pairs(text):
    base, spans = secrets.find_spans(text)
    assert set(spans) - set(base) == plain_links(text, base, secrets.weak_parts(text, base))
    assert sum(s in base for s in spans) == len(base)


def test_parts_that_overlap_are_no_complements():
    assert secrets.find_spans("see https://docs.example.com/Pages/AbCdEf1234567890GhIjKl there")[1] == []
    assert secrets.find_spans("user: Zk3xQ9vLm2Tt7Rb8Wc1Yp4Hd")[1] == []
    both = secrets.find_spans("user: Zk3xQ9vLm2Tt7Rb8Wc1Yp4Hd then Qq4yR8wKn3Uu6Sc9Xd2Zq5Je")[1]
    assert {s.kind for s in both} == {"ident", "token"}


def test_scan(odd_docs, no_docs):
    rows = secrets.scan_digest(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        if r["doc_id"] is not None:
            want = plain_spans(ODD[r["doc_id"]])
            assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
            assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(w.startswith(k) for w in want) for k in BASE)
    hidden = secrets.masked(odd_docs)
    assert hidden.columns == odd_docs.columns and hidden.count() == odd_docs.count()
    assert hidden.filter("doc_id = 11").first()["text"] == "[secret] and [secret]"
    assert hidden.filter("doc_id = 11").first()["n_chars"] == len("[secret] and [secret]")
    assert secrets.scan_digest(no_docs).count() == 0


def plain_rules(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    covered = {q for k, w in enumerate(windows) if windows.count(w) > 1 for q in range(k, k + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_rules(spark, odd_docs, no_docs):
    extra = ["a b c d e f a b c d e g " * 2, "q #1 | <x> & 50% $ *\n\n \nq #1 | <x> & 50% $ *", "r s t u v r s t u v r s t u v w x y"]
    docs = spark.createDataFrame(list(enumerate([t if t is None or len(t) < 4000 else t[:400] for t in ODD] + extra)), "doc_id long, text string").selectExpr("*", "'en' as lang", "cast(null as string) as source")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = quality_rules.rule_report(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, chars, symbols, dup, repeat = want = plain_rules(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (n < 10 or 100 * repeat > 20 * n)
        assert not (r["kept"] and r["base_failed"])
    assert quality_rules.rule_report(odd_docs).count() == odd_docs.count()
    assert quality_rules.apply_rules(odd_docs).columns == odd_docs.columns
    assert quality_rules.rule_report(no_docs).count() == 0 and quality_rules.apply_rules(no_docs).count() == 0


def test_thresholds_adapt(spark):
    plain = [(i, " ".join(f"word{(i * 7 + k * 13) % 9973}" for k in range(60)), "en", "a") for i in range(80)]
    spiced = [(i, " ".join(f"word{(i * 7 + k * 13) % 9973}#" for k in range(60)), "en", "b") for i in range(100, 180)]
    odd = [(999, " ".join(f"term{k}#" for k in range(60)), "en", "a")]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.rule_report(spark.createDataFrame(plain + spiced + odd, "doc_id long, text string, lang string, source string")).collect()}
    assert not kept[999] and all(kept[i] for i, *_ in plain + spiced)


def test_rules_run_no_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for df in (quality_rules.rule_report(docs), quality_rules.apply_rules(docs)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h2>Site</h2><nav><ul><li><a href=/>Home</a></ul></nav></header><div class="cookie-notice">We use cookies</div>
<div class=adBox>Buy</div><form><input name=q><button>Go</button></form><div id="sidebar"><p>Other news stories here</div>
<article><h1>Head &amp; line</h1><p>First <b>bold</b>ly&nbsp;said 1 &lt; 2.<p>Second<br>line.<ul><li>one<li>two</ul><script>x</script></article>
<section class="reader-comments"><p>I disagree with all of this, a lot of words here to be dense and long enough to win.</p></section>
<footer>&copy; x</footer></body></html>"""


def test_html():
    assert html.extract(PAGE) == "Head & line First boldly said 1 < 2. Second line. one two"
    for empty in (None, "", "   ", "<html><body></body></html>", "<script>only()"):
        assert html.extract(empty) == ""
    assert html.extract("plain a < b text") == "plain a < b text"
    assert html.extract("<div><p>unclosed <b>bold<p>next <a href='x>y'>link</a> end") == "unclosed bold next link end"
    divs = "<body><div><a href=/a>l1</a> <a href=/b>l2</a> <a href=/c>l3</a></div><div>" + "".join(f"<p>Long paragraph number {k} with many plain words inside it.</p>" for k in range(5)) + "</div></body>"
    assert html.extract(divs).startswith("Long paragraph number 0") and "l2" not in html.extract(divs)
    html.extract("<" * 3000 + "<p" * 3000)
    html.extract("<div>" * 5000 + "deep")


def test_names_of_wrappers_decide_nothing():
    """Wrappers named after parts beside the article stay; such parts themselves go."""
    one, two = ("".join(f"<p>Long {w} number {k} with many plain words inside it.</p>" for k in range(5)) for w in ("paragraph", "passage"))
    plain = [" ".join(f"Long {w} number {k} with many plain words inside it." for k in range(5)) for w in ("paragraph", "passage")]
    menu, side = "<div class=menu><a href=/a>l1</a> <a href=/b>l2</a></div>", "<div class=sidebar><p>Side text</p></div>"
    for name in ("content has-sidebar", "no-sidebar", "elementor-widget-container", "commentsOff"):
        assert html.extract(f'<body>{menu}<div class="{name}">{one}</div>{side}</body>') == plain[0]
        assert html.extract(f'<body>{menu}<div class="{name}"><div>{side}<article>{one}</article></div></div></body>') == plain[0]
        assert html.extract(f'<body>{menu}<div class="{name}">{one}</div><div class="{name}">{two}</div></body>') == " ".join(plain)
    assert html.extract(f'<article><header class="entry-header"><h1>The title</h1></header>{one}</article>') == "The title " + plain[0]
    assert html.extract('<div class="widget">A page in one block, without paragraphs.</div><div class="footer">foot</div>') == "A page in one block, without paragraphs."
    said = "".join(f"<p>I say {k} too</p>" for k in range(4))
    assert html.extract(f"<body>{menu}<article>{one}</article><div class=comments>{said}</div></body>") == plain[0]


PARAGRAPHS = ["The first paragraph of the text says a good deal about the matter at hand, in plain words.",
              "A second one goes on with it, at length, and with <b>some</b> stress on what matters most here.",
              "The third ends the matter; nothing is left to be said about it, so that all readers may go home."]


def plain_main_text(page):
    """The paragraphs and headings of the page in order, by a DOM of the standard library: without links, readers' talk and menus."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.beside, self.stack = [], 0, []

        def handle_starttag(self, tag, attrs):
            name = dict(attrs).get("class") or ""
            beside = tag in ("nav", "footer", "script") or name in ("menu", "talk comments", "links")
            self.stack.append(beside)
            self.beside += beside

        def handle_endtag(self, tag):
            self.beside -= self.stack.pop()

        def handle_data(self, data):
            if not self.beside:
                self.out.append(data)

    reader = Reader()
    reader.feed(re.sub("</(p|h1|h2|section|div|li|article)>", lambda m: " " + m[0], page))
    return " ".join("".join(reader.out).split())


def test_density_without_an_article_element():
    """Nested sections, lists of links and comments around paragraphs: the same text as a plain walk over the tree gives."""
    links = "<ul>" + "".join(f'<li><a href="/{k}">Some link number {k} to another page</a></li>' for k in range(8)) + "</ul>"
    body = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
    talk = '<div class="talk comments">' + "".join(f"<div><p>I for one say {k} to that</p></div>" for k in range(6)) + "</div>"
    pages = [
        f'<body><div class="menu">{links}</div><div><section>{body}</section></div><footer>foot</footer></body>',
        f'<body><nav>{links}</nav><div><div><section><h2>One</h2>{body}</section><section><h2>Two</h2>{body}</section></div></div></body>',
        f'<body><div class="links">{links}</div><article>{body}{talk}</article>{talk}</body>',
        f'<body><div><div class="links">{links}</div><div>{body}</div><div class="links">{links}</div></div></body>',
        f'<body><div id="content">{body}{body}{talk}</div></body>',
        f"<body><main>{body}<div class='links'>{links}</div></main><script>var x = '<p>no</p>'</script></body>",
    ]
    for page in pages:
        assert html.extract(page) == plain_main_text(page)


def test_text_beside_the_densest_part_stays():
    body, plain = "".join(f"<p>{p}</p>" for p in PARAGRAPHS), re.sub("</?b>", "", " ".join(PARAGRAPHS))
    assert html.extract(f"<body><article>Lead sentence.<div>{body}</div>A last word</article></body>") == f"Lead sentence. {plain} A last word"
    assert html.extract(f'<article><div class="post-header"><h1>Title</h1></div><div>{body}</div><p class="legal">By law.</p></article>') == f"Title {plain} By law."
    assert html.extract(f'<div class="post"><div class="post-header"><h1>Title</h1></div><div>{body}</div></div>').endswith(plain)
    assert html.extract(f"<article>{body}<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> holds</p></article>") == f"{plain} so x=1 holds"
    assert html.extract(f'<article>{body}<p class="ad">Buy this now</p></article>') == plain
    assert html.extract(f'<div>{body}{body}<div class="related-posts"><p>One teaser</p><p>Two teasers</p><p>More teasers</p></div></div>') == f"{plain} {plain}"
    wrapped = f'<main><div class="comments-open"><article>{body}</article></div><div class="comments"><article><p>My word on it</p></article></div></main>'
    assert html.extract(wrapped) == plain
    assert html.extract("<form>" * 3000 + f"<article>{body}</article>") == plain


def test_odd_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x y</p>", "t", 5), (None, None, None, None, None)], "page_id long, url string, html string, text string, n_chars long")
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html.extract_pages(pages).collect()) == [(0, "", 0), (1, "x y", 3)]
    assert html.extract_pages(pages.limit(0)).count() == 0


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = html.extract_pages(pages).collect()
    assert len(rows) == pages.count() and all(r["n_chars"] == len(r["text"]) for r in rows)
    want = {r["page_id"]: re.search("<article>(.*)</article>", r["html"], re.S)[1] for r in pages.collect() if r["html"]}
    import html as entities

    for r in rows:
        if r["page_id"] in want:
            inner = re.sub("<[^>]*>", " ", re.sub("</?b>", "", want[r["page_id"]]))
            assert r["text"] == " ".join(entities.unescape(inner).split())
    odd = spark.createDataFrame([(None, None, None), (1, None, "<p>x"), (1, None, "<p>x")], pages.schema)
    assert sorted(r["text"] for r in html.extract_pages(odd).collect()) == ["", "x", "x"]


def _in_article(inner):
    return f"<html><body><nav>menu</nav><article><h1>Title</h1><p>{'Plain words of the article. ' * 10}</p>{inner}<p>{'More words of it here. ' * 10}</p></article></body></html>"


@pytest.mark.parametrize("inner", [
    "<p title='the hidden treasure'>Keep</p>", "<p aria-label='hidden'>Keep</p>", "<p>x <a href='/hidden/list'>Keep</a></p>", "<p>x <a href='/x?id=ad'>Keep</a></p>", "<p data-id='ad 12'>Keep</p>",
    "<section id='discussion'><h2>Discussion</h2><p>Keep what the results say.</p></section>", "<p class='related-work'>Keep</p>", "<p data-x=\"style='display:none'\">Keep</p>",
])
def test_attributes_are_read_by_name(inner):
    assert "Keep" in html.extract(_in_article(inner))


@pytest.mark.parametrize("inner", ["<p hidden>Gone</p>", "<p aria-hidden='true'>Gone</p>", "<div class='related'><a href=x>Gone one</a> <a href=y>Gone two</a></div>", "<div class=comments><p>Gone</p></div>", "<div style='display: none'>Gone</div>"])
def test_parts_beside_the_article_still_go(inner):
    assert "Gone" not in html.extract(_in_article(inner))


def test_parts_of_any_length():
    host, name = ".".join("abcdefghijk") + ".example.com:8080", "n" * 500
    text = f"{host} token Ab3dEf6hIj9kLmN0pQrS2tUv and user_id:{' ' * 30}{name}"
    found = {(s.kind, text[s.start : s.end]) for s in secrets.find_spans(text)[1]}
    assert ("endpoint", host) in found and ("ident", name) in found
    assert secrets.find_spans("a." * 200_000 + " user" + " " * 200_000)[1] == []
