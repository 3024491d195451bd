from __future__ import annotations

import hashlib
import html
import math
import random
import re
import string
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from veritome.llm import bpe, html_extract, pii, quality_knn, quality_rules, secret_scan

DOCS = "doc_id long, text string, lang string, _text string, score double"
PATH = bpe.vocabulary("word_bpe_49k.json")
TEXTS = [None, "", " \n\t", "Hello world, it's I'LL don't", "<|endoftext|>x <|startoftext|>", "ΑΣ ΣΑΣ ß ẞ İ", "日本語 123 ½", "é é", "a" * 5000, "word " * 30_000, "\x00\x1c\x85 x", "😀😁 !!", "\u088f\u0558 new letters"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding(), t.no_truncation()
    return t


@pytest.fixture(scope="module")
def own():
    return bpe.tokenizer(PATH)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "clash", 0.5) for i, t in rows], DOCS)


# ---------------------------------------------------------------- encoding
def test_encoding_fixed(own, library):
    texts = [t or "" for t in TEXTS]
    assert own.encode_batch(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=300)
@given(st.text(max_size=60))
def test_encoding_any(own, library, t):
    ids = own.encode_batch([t])[0]
    assert ids == library.encode(t, add_special_tokens=False).ids
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=300)
@given(st.text(string.ascii_lowercase + "'.", min_size=1, max_size=40))
def test_encoding_words(own, library, t):
    assert own.encode_batch([t])[0] == library.encode(t, add_special_tokens=False).ids


def test_compatible_pairs_are_those_that_merge_to_themselves(own):
    r = random.Random(3)
    ends = [i for t, i in own.reachable.items() if t.endswith(own.suffix)]
    inner = [i for t, i in own.reachable.items() if not t.endswith(own.suffix)]
    a, b = np.array(r.choices(inner, k=3000)), np.array(r.choices(ends, k=3000))
    truth = [own._exact(own.token[x] + own.token[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert own.compatible(a, b).tolist() == truth and 100 < sum(truth) < 2990


def test_documents_round_trip(spark, library):
    df = frame(spark, list(enumerate(TEXTS)) + [(0, None)])
    got = {r.doc_id: r for r in bpe.digest_documents(df, PATH).collect()}
    full = {r.doc_id: r for r in bpe.encode_documents(df, PATH).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert full[i].ids == ids and full[i].decoded == library.decode(ids, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(full[i].decoded))
    assert bpe.digest_documents(df.limit(0), PATH).count() == 0


# ---------------------------------------------------------------- quality rules
def brute_rules(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    inside = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside), failed


@settings(max_examples=200)
@given(st.lists(st.sampled_from(["a", "b", "é#", "\n", " ", "\u00a0", "x y z a b c d e ", "\r\n"]), max_size=80))
def test_rules_against_brute_force(parts):
    t = "".join(parts)
    assert quality_rules.repeat_words(t.encode().split()) == brute_rules(t)[4]
    assert quality_rules.duplicate_lines(t) == brute_rules(t)[3]


def test_rules(spark):
    plain = "the river rises in spring and the gauges along its banks record every flood that passes the old town before it reaches the sea"
    texts = [*TEXTS, plain, plain + "\n" + plain, "qz#%& " * 30 + plain, "%%% ### $$$ " * 40]
    got = {r.doc_id: r for r in quality_rules.measure_documents(frame(spark, list(enumerate(texts))), bpe.vocabulary("piece_bpe_32k.model")).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i][1:7]) == brute_rules(t)
    assert got[len(TEXTS)].kept and not got[len(texts) - 1].kept and not got[0].kept
    assert quality_rules.script("привет мир") == "Other" and quality_rules.script("é") == "Latin"


# ---------------------------------------------------------------- personal data
PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_pii(t):
    out = []
    for rank, p in enumerate(PATTERNS):
        for m in re.finditer(p, t):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))]
            good = (True, rank == 1 and all(int(x) <= 255 for x in m[0].split(".")), 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0, 10 <= len(digits) <= 15)[rank]
            out += [(m.start(), rank, m.end())] if good else []
    return sorted(out)


@settings(max_examples=500)
@given(st.lists(st.sampled_from(["a", "b.", "@", "1", "22", "255", ".", "-", " ", "+", "(", ")", "4111111111111111", "x@y.z", "%", "é", "+1 (222) 555-1234", "٣"]), max_size=25))
def test_plain_spans_against_brute_force(parts):
    t = "".join(parts)
    assert [tuple(s) for s in pii.plain_spans(t)] == brute_pii(t)


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail john.doe (at) example (dot) com now", "email", "john.doe (at) example (dot) com"),
        ("john dot doe at example dot com", "email", "john dot doe at example dot com"),
        ("write j\u043ehn@ex\u0430mple.com today", "email", "j\u043ehn@ex\u0430mple.com"),
        ("call plus one four one five five five five zero one two three", "phone", "plus one four one five five five five zero one two three"),
        ("card four one one one one one one one one one one one one one one one ok", "card", "four one one one one one one one one one one one one one one one"),
        ("\uff14111 1111 1111 1111", "card", "\uff14111 1111 1111 1111"),
        ("ip one nine two dot one six eight dot zero dot one end", "ip", "one nine two dot one six eight dot zero dot one"),
        ("host 192[.]168[.]1[.]20 down", "ip", "192[.]168[.]1[.]20"),
        ("ip one ninety-two dot one hundred and sixty eight dot ten dot two hundred five end", "ip", "one ninety-two dot one hundred and sixty eight dot ten dot two hundred five"),
        ("ip ten.zero.twenty.forty-two end", "ip", "ten.zero.twenty.forty-two"),
        ("call plus four nine double five triple one zero two three", "phone", "plus four nine double five triple one zero two three"),
        ("it is john.doe at gmail.com, ask", "email", "john.doe at gmail.com"),
        ("Contact me at: jane_99 at mail.example.org.", "email", "jane_99 at mail.example.org"),
        ("ping 192 . 168 . 1 . 10 now", "ip", "192 . 168 . 1 . 10"),
        ("or jane_at_example_dot_com ok", "email", "jane_at_example_dot_com"),
        ("call +44 twenty seven nine four six oh nine five eight", "phone", "+44 twenty seven nine four six oh nine five eight"),
        ("a [dot] b [dot] c [dot] d [dot] e [dot] f [at] site [dot] org", "email", "a [dot] b [dot] c [dot] d [dot] e [dot] f [at] site [dot] org"),
        ("x" * 70 + " [at] example [dot] org", "email", "x" * 70 + " [at] example [dot] org"),
        ("x" * 1000 + " at " + "y" * 900 + " dot org", "email", "x" * 1000 + " at " + "y" * 900 + " dot org"),
    ],
)
def test_disguises(text, kind, found):
    base, spans = pii.find_spans(text)
    assert f"{kind}:{text.index(found)}:{text.index(found) + len(found)}" in map(str, spans) and set(base) <= set(spans)


@pytest.mark.parametrize("text", ["look at the dot com boom", "visit us at example.com", "one two three go", "she came at noon. Then left", "un deux trois", "pi is three dot one four", "see index.html at example.com", "look me up at gmail.com", "mail us at example.com", "mail john.doe at home.Then he left"])
def test_plain_prose_is_left_alone(text):
    assert pii.find_spans(text) == ([], [])


def test_look_at_point_dot_product_is_a_name():
    assert pii.find_spans("look_at_point_dot_product(x) and meet_at_noon, 1 . 2 . 3 . 400") == ([], [])


@settings(max_examples=200)
@given(st.lists(st.text("ab9_", min_size=1, max_size=80), min_size=1, max_size=12), st.lists(st.text("xyz", min_size=1, max_size=80), min_size=2, max_size=12), st.integers(0, 3), st.integers(0, 2), st.booleans())
def test_disguised_addresses_of_any_length_are_read_outwards(local, host, dot, at, before):
    """Against the address that was written: whatever its parts, the span is the whole of it."""
    dots, ats = (" [dot] ", "(dot)", " dot ", " {punkt} ")[dot], (" [at] ", "(at)", " <arroba> ")[at]
    address = dots.join(local) + ats + dots.join(host)
    text = ("see; " if before else "") + address + "; and"
    start = len(text) - len(address) - 5
    assert ("email", start, start + len(address)) in [(pii.KINDS[s.rank], s.start, s.end) for s in pii.find_spans(text)[1]]


def test_pii_is_linear():
    for t in ("1" * 200_000, "a" * 200_000, "a@" * 100_000, "1." * 100_000, "+1 " * 60_000, "at dot " * 30_000, " at a." * 30_000, "a.b at " * 30_000, "double one " * 20_000, "one hundred " * 20_000, " " * 100_000 + "at", "a at a " * 20_000, "_at_a" * 30_000, "1 . " * 40_000, "x [at] " * 20_000, "a.b" * 30_000 + " at gmail.com"):
        pii.find_spans(t)


def test_octets():
    """All of 0 to 255 in words, in full and in groups."""
    units, teens, tens = "zero one two three four five six seven eight nine".split(), list(pii.TEENS), list(pii.TENS)
    below = units + teens + [t if not u else f"{t}-{units[u]}" for t in tens for u in range(10)]
    for n in range(256):
        h, rest = divmod(n, 100)
        full = below[rest] if not h else f"{units[h]} hundred" + (f" and {below[rest]}" if rest else "")
        assert pii._octet(full) == str(n)
        if h and rest >= 10:
            assert pii._octet(f"{units[h]} {below[rest]}") == str(n)


def test_pii_documents(spark):
    rows = [(1, "a@b.co and +1 (222) 555-1234"), (2, None), (3, ""), (3, "")]
    got = [(r.doc_id, [(s.kind, s.start, s.end) for s in r.spans]) for r in pii.scan_documents(frame(spark, rows)).collect()]
    assert sorted(got) == [(1, [("email", 0, 6), ("phone", 11, 28)]), (2, []), (3, []), (3, [])]
    assert pii.redact("to a@b.co now") == "to <email> now"


# ---------------------------------------------------------------- secrets
KEY = "".join(f"[{c.upper()}{c}]" for c in "password")


def brute_secrets(t):
    words = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
    out = [(m.start(), 0, m.end()) for m in re.finditer(rf"""({words})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32])


def test_secrets(spark):
    r = random.Random(7)
    parts = ["password", " = ", ":", '"', "Token", "api_key", "apikey=", "secret", "abcdefghij", "AKIA", "ABCDEF1234567890", "0123456789abcdef" * 2, " ", "é", "ſecret: abcdefghijk", "=", "x"]
    texts = ["".join(r.choices(parts, k=r.randrange(1, 25))) for _ in range(400)] + ["", "token=abcdefgh " * 3000]
    got = {x.doc_id: x for x in secret_scan.scan_secrets(frame(spark, [*enumerate(texts), (9999, None)])).collect()}
    for i, t in enumerate(texts):
        assert [tuple(s)[:3] for s in got[i].base] == brute_secrets(t), t
        assert set(got[i].base) <= set(got[i].spans) and not any(hasattr(s, "text") for s in got[i].spans)
    assert got[9999].spans == []


def test_randomness_battery(spark):
    r = random.Random(11)
    make = lambda alphabet, n: "".join(r.choices(alphabet, k=n))
    base62 = string.ascii_letters + string.digits
    kinds = [("", base62, 24, 0.9), ("", base62, 32, 0.95), ("", base62 + "+/", 40, 0.95), ("", base62 + "-_", 32, 0.9), ("", "0123456789ABCDEF", 40, 0.95), ("", "0123456789abcdef", 24, 0.9)]
    kinds += [("", string.digits + string.ascii_lowercase, 24, 0.8), ("", string.digits + string.ascii_lowercase, 32, 0.9), ("", string.ascii_uppercase + "234567", 32, 0.8), ("", string.ascii_uppercase + "234567", 40, 0.9), ("ghp_", base62, 36, 0.95)]
    random_ = [f"see {prefix}{make(a, n)} there" for prefix, a, n, _ in kinds for _ in range(60)]
    prose = ["someVeryLongCamelCaseIdentifierNameHere", "some_very_long_snake_case_identifier_2020", "/usr/local/lib/python3/site-packages/numpy", "550e8400-e29b-41d4-a716-446655440000", "A1" * 20, string.ascii_letters + string.digits, "thblereeratblexyzabcdefgh", "2024-01-02T03-04-05-000000000Z", "1234567890" * 3]
    got = {x.doc_id: x.spans for x in secret_scan.scan_secrets(frame(spark, list(enumerate(random_ + prose)))).collect()}
    for k, (_, alphabet, n, least) in enumerate(kinds):
        assert sum(bool(got[i]) for i in range(60 * k, 60 * k + 60)) >= least * 60, (alphabet, n)
    assert [p for i, p in enumerate(prose, len(random_)) if got[i]] == []


def test_false_discoveries_are_held_over_the_whole_table():
    """The line over bins against the step-up rule over the p-values themselves: as strict, and by a bin at most stricter."""
    r = random.Random(3)
    for m, secrets in ((1, 1), (1000, 0), (1000, 5), (100_000, 50)):
        ps = sorted([10 ** -r.uniform(3, 20) for _ in range(secrets)] + [r.random() for _ in range(m - secrets)])
        found = max([i for i, p in enumerate(ps, 1) if p <= secret_scan.FDR * i / m], default=0)
        bins = [min(secret_scan.LAST_BIN, math.floor(-math.log10(p) * secret_scan.BINS)) for p in ps]
        line = secret_scan._line(Counter(bins))
        mine = sum(b >= line for b in bins)
        assert mine <= found and all(p > secret_scan.FDR * found / m / 10 ** (2 / secret_scan.BINS) for p in ps[mine:found])


def test_secret_scan_of_nothing(spark):
    assert secret_scan.scan_secrets(frame(spark, [])).count() == 0
    long_ = "word " * 100_000 + "password=hunter22hunter22 " + "x" * 50_000
    (row,) = secret_scan.scan_secrets(frame(spark, [(1, long_)])).collect()
    assert [(s.start, s.end) for s in row.spans] == [(500_000, 500_025)]


def test_secret_plan_is_native(spark):
    plan = secret_scan.scan_secrets(frame(spark, [(1, "x")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# ---------------------------------------------------------------- pages
def test_deep_nesting_and_stray_end_tags():
    import time

    tree = html_extract.trained_tree()
    words = "word " * 40
    deep = "<div>" * 30_000 + f"<div class=sidebar><p>{words}side</p></div>" + "</div>" * 30_000
    page = f"<body><nav>{deep}</nav><article><p>{words}end.</p>" + "</section>" * 30_000 + f"<div class=sidebar>{deep}</div></article>"
    began = time.perf_counter()
    assert html_extract.main_text(page, tree) == f"{words}end."
    assert time.perf_counter() - began < 20


def test_main_text():
    tree = html_extract.trained_tree()
    page = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href=1>Home</a></ul></nav>
    <div class="cookie-notice">We use cookies</div><article><h1>Title &amp; more</h1><p><b>First
    line<br>second&nbsp;line.<p>Ti.</p><aside>side</aside><form><label>Name</label></form><script>var t="</p>";</script><div class="ad">Buy now</div><!-- <p>no</p> -->
    <ul><li>one</li><li>two <a href=x>link</a></ul><section id="comments"><article><p>nice!</p></article></section></article><footer>&copy; 2020</footer></body>"""
    assert html_extract.main_text(page, tree) == "Title & more\n\nFirst line second line.\n\nTi.\n\none\n\ntwo link"
    bare = "<div id=nav><a href=1>Home</a></div><div><h2>Head line here</h2><p>" + "word " * 30 + "</p><p>Short one.</p><p>" + "word " * 30 + "</p></div><div>Copyright \u00a9 2020</div>"
    assert html_extract.main_text(bare, tree).count("\n\n") == 3 and "2020" not in html_extract.main_text(bare, tree)
    assert html_extract.main_text("", tree) == ""


def test_tree_learns_its_layouts_and_tells_others():
    rows, said = html_extract.labelled()
    tree = html_extract.Tree(rows, said)
    assert np.mean([tree(x) == bool(y) for x, y in zip(rows.tolist(), said, strict=True)]) > 0.98
    assert html_extract.FEATURES[tree.feature] in ("core", "words", "link_density")
    right = []
    for i, one in enumerate(html_extract.LAYOUTS):
        others = html_extract.Tree(*html_extract.labelled(html_extract.LAYOUTS[:i] + html_extract.LAYOUTS[i + 1 :]))
        rows, said = html_extract.labelled((one,))
        right += [others(x) == bool(y) for x, y in zip(rows.tolist(), said, strict=True)]
    assert np.mean(right) > 0.93


LONG = "river water rises slowly and towns along its banks in spring " * 4


@pytest.mark.parametrize(
    ("start", "main"),
    [
        ('div title="the hidden river"', True), ('div data-id="related"', True), ("div data-x='<b hidden>' class=text", True), ('section id="tags-and-labels"', True), ('section id="share-of-energy"', True),
        ('div class="related-work"', True), ("div class=notice-of-meeting", True), ("div hidden", False), ('div style="color:red; display : none"', False), ('div class="replies"', False), ('div class="related posts"', False),
        ('div class="ad"', False), ("div class='col-md-4 adBanner'", False), ("div role=complementary", False), ("article", False), ("aside", False), ("form", False),
    ],
)
def test_parts_of_an_article(start, main):
    page = f"<html><body><nav><a>Home</a></nav><article><h1>Title of it</h1><p>{LONG}one</p><{start}><p>{LONG}part</p></{start.split()[0]}><p>{LONG}two</p></article></body></html>"
    want = ["Title of it", f"{LONG}one", *[f"{LONG}part"] * main, f"{LONG}two"]
    assert html_extract.main_text(page, html_extract.trained_tree()).split("\n\n") == want


def test_pages_without_an_article_element():
    tree = html_extract.trained_tree()
    assert html_extract.main_text(f"<body><h1>Head line</h1><p>{LONG}.</p><p>{LONG}.</p><p>The end.</p></body>", tree).endswith("The end.")
    page = f"<body><div><h1>Head line</h1><p>{LONG}.</p><p>{LONG}.</p></div><div><p>Anna: what a great article, thank you!</p></div><div>We share what we learn about you with partners.</div></body>"
    assert html_extract.main_text(page, tree) == f"Head line\n\n{LONG}.\n\n{LONG}."
    page = f"<div><p>{LONG}.</p><p>{LONG}.</p><h3>2 comments</h3><p>{LONG}.</p><p>Nice.</p></div>"
    assert html_extract.main_text(page, tree) == f"{LONG}.\n\n{LONG}."


def plain_article(page):
    """The blocks of the only article of a page of the standard tables, by plain substitutions."""
    body = page[page.find("<article>") : page.rfind("</article>")] if "</article>" in page else page[page.find("<article>") :]
    body = re.sub(r"(?s)<(script|style|aside|form|nav)\b.*?</\1>|<!--.*?-->|<div class=.?(?:ad|comments?|share|related)\b.*?</div>|<section[^>]*comment.*?</section>|<footer.*", "", body)
    parts = re.split(r"</?(?:p|h\d|li|ul|ol|div|article|blockquote|section|table|tr|td|pre|aside|form|header|footer|main)\b[^>]*>", body)
    plain = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br[^>]*>", " ", x))).split()) for x in parts)
    return "\n\n".join(filter(None, plain))


def test_all_pages_equal_their_articles(spark):
    rows = html_extract.op4_html_extract(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html"), "page_id").collect()
    assert [r["page_id"] for r in rows if r["text"] != plain_article(r["html"] or "") or r["n_chars"] != len(r["text"])] == []


def test_broken_pages_are_linear():
    tree = html_extract.trained_tree()
    for page in ('<a "' * 100_000, "<div>" * 100_000 + "x", "<!-" * 200_000, "<script " * 100_000, "<p>x" * 50_000, "&amp;" * 100_000):
        html_extract.main_text(page, tree)


def test_extract_pages(spark):
    df = spark.createDataFrame([(1, "u", "<p>" + "word " * 20, "c"), (2, None, None, "c"), (2, "v", "", "c")], "page_id long, url string, html string, text string")
    got = sorted(html_extract.extract_pages(df).collect(), key=lambda r: (r.page_id, r.url or ""))
    assert [(r.page_id, r.url, len(r.text)) for r in got] == [(1, "u", 99), (2, None, 0), (2, "v", 0)]
    assert html_extract.extract_pages(df.limit(0)).count() == 0


# ---------------------------------------------------------------- classifier
def junk(r):
    return " ".join(w + r.choice(["###", "%%%", "!!"]) for w in good(r).upper().split())


def good(r):
    return " ".join(r.choices(["the", "of", "river", "water", "rises", "slowly", "and", "towns", "along", "its", "banks", "in", "spring"], k=r.randrange(20, 80)))


def test_classifier(spark):
    r = random.Random(2)
    rows = [(i, good(r) if i % 4 else junk(r)) for i in range(400)]
    docs = frame(spark, [*rows, (1000, None), (1001, ""), (5, rows[5][1])])
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(300)] + [(None, 1), (7, None), (8, 0)], "doc_id long, quality int")
    model = quality_knn.train(docs, labels, per_class=60)
    assert len(model.vectors) <= 120 and model.vectors.shape[1] <= quality_knn.RANK
    got = {x.doc_id: x.score for x in quality_knn.score_documents(docs, model).collect()}
    assert got[1000] == got[1001] == 0.5 and all(0 <= s <= 1 for s in got.values())
    assert sum((got[i] >= 0.7) == (i % 4 > 0) for i, _ in rows[300:]) >= 95
    again = quality_knn.train(docs.repartition(7), labels.repartition(3), per_class=60)
    assert np.allclose(again.vectors @ again.vectors.T, model.vectors @ model.vectors.T, atol=1e-4)


def test_classifier_without_labels(spark):
    docs, none = frame(spark, [(1, "some text"), (2, None)]), spark.createDataFrame([], "doc_id long, quality int")
    model = quality_knn.train(docs, none)
    assert [x.score for x in quality_knn.score_documents(docs, model).collect()] == [0.5, 0.5]
    assert quality_knn.score_documents(docs.limit(0), model).count() == 0


def test_held_out_rows_are_never_learned(spark):
    from zlib import crc32

    df = spark.range(50).selectExpr("id as doc_id")
    got = {x.doc_id: x.ok for x in df.select("doc_id", quality_knn.learns(df.doc_id).alias("ok")).collect()}
    assert all(ok == (crc32(str(i).encode()) % 4 != 2) for i, ok in got.items())


# ---------------------------------------------------------------- disguises behind their gates
@pytest.mark.parametrize("shut", [f"{a}{o}{i}{w}{i}{c}{a}" for a in ("", " ") for i in ("", " ") for o, c in ("[]", "()", "{}", "<>") for w in ("at", "a", "@", "AT", "arroba")])
def test_every_shut_at_is_rewritten(shut):
    text = f"write jane{shut}example.com now"
    assert [text[s.start : s.end] for s in pii.find_spans(text)[1]] == [f"jane{shut}example.com"]


@pytest.mark.parametrize("dot", [f"{a}{o}{i}{w}{i}{c}{a}" for a in ("", " ") for i in ("", " ") for o, c in ("[]", "()", "{}", "<>") for w in ("dot", ".", "punkt", "point")] + [" dot ", "  PUNTO "])
def test_every_dot_is_rewritten(dot):
    text = f"write jane@example{dot}com now"
    assert f"jane@example{dot}com" in [text[s.start : s.end] for s in pii.find_spans(text)[1]]


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("write jane [\u0430t] example.com now", "email", "jane [\u0430t] example.com"),
        ("write jane [a\u200bt] example [d\u200bot] com now", "email", "jane [a\u200bt] example [d\u200bot] com"),
        ("call plus four nine/one five/fi\u200bve five/five zero/one two/three now", "phone", "plus four nine/one five/fi\u200bve five/five zero/one two/three"),
        ("call (plus four(nine)one/five/five/five/five/zero/one/two now", "phone", "plus four(nine)one/five/five/five/five/zero/one/two"),
        ("host one.2.3.4 now", "ip", "one.2.3.4"),
        ("host 1.two.3.4 now", "ip", "1.two.3.4"),
    ],
)
def test_stacked_disguises(text, kind, found):
    assert (kind, found) in [(pii.KINDS[s.rank], text[s.start : s.end]) for s in pii.find_spans(text)[1]]


# ---------------------------------------------------------------- long tags
BIG = "x" * 100_000


@pytest.mark.parametrize(
    "odd",
    [
        f'<img src="data:image/png;base64,{BIG}">',
        f"<!DOCTYPE {BIG}>",
        f'<div class="ad" data-x="{BIG}"><p>Buy this thing now, it is very cheap today and only today.</p></div>',
        f'<div class="ad" data-x="{BIG} > <b> {BIG}"><p>Buy this thing now, it is very cheap today and only today.</p></div>',
        f'<script data-x="{BIG}">var code = 1;</script>',
        f'<script data-x="{BIG} < {BIG}">var code = 1;</script>',
    ],
)
def test_long_tags_are_tags(odd):
    tree = html_extract.trained_tree()
    first, last = "The first paragraph of the article has a good number of words in it.", "The last paragraph of the article has a good number of words in it too."
    page = f"<html><body><article><p>{first}</p>{odd}<p>{last}</p></article></body></html>"
    assert html_extract.main_text(page, tree) == f"{first}\n\n{last}"


@pytest.mark.parametrize("part", ['<a "', "<a '\"", '<a "<a ""', "<a \"'<b '\"", '<div class="', "<script x='<", "<!", "</a ' "])
def test_broken_quotes_are_linear(part):
    import time

    start = time.perf_counter()
    html_extract.blocks(part * 100_000)
    assert time.perf_counter() - start < 10
