from __future__ import annotations

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veritome.functions import completion, matching, similarity, text

CARD = '{"problema":"a","dados":"b","metodo":"c","metrica":"d","limitacao":null,"evidencia":{"trecho":"twenty characters at least","pagina":3}}'


def _column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_page_numbers(spark):
    yes, no = ["12", "Page 3", "- 4 -", "3 of 10"], ["3 Methods", "0.81", "2019 data"]
    assert _column(spark, yes + no, text.is_page_number) == [True] * 4 + [False] * 3


def test_native_text(spark):
    assert _column(spark, ["", "abcdef", "x" * 10, "x" * 14], text.approx_tokens) == [0, 2, 2, 4]  # 2.5 and 3.5 go to the even side
    assert _column(spark, ["a  b \n\n\n\n c ", "  x"], text.collapse_spaces) == ["a b\n\nc", "x"]
    assert _column(spark, ["Journal X,  p. 3", "12"], text.line_key) == ["journal x, p. #", "#"]
    assert _column(spark, ["a b/c", "///"], text.slug) == ["a-b-c", "x"]
    assert _column(spark, ["0.25", "0.0", "0.7"], lambda c: text.format_temperature(c.cast("double"))) == ["0.25", "0.0", "0.7"]
    assert _column(spark, ["N/A", " null ", "real"], text.null_if_sentinel) == [None, None, "real"]
    assert _column(spark, ["One. Two! three? Four.\n\nFive"], text.sentences) == [["One.", "Two! three?", "Four.", "Five"]]
    assert _column(spark, ["a_b_c_d.pdf", "a_b.pdf"], text.short_name) == ["a_b_c", "a_b"]


def test_match_form():
    assert matching.match_form("“Deep  learning”—state-of-the-art ﬁndings ( see Fig. 1 ) .") == '"deep learning"-state-of-the-art findings (see fig. 1).'


@given(st.text(max_size=60))
def test_match_form_is_idempotent(s):
    once = matching.match_form(s)
    assert matching.match_form(once) == once


def test_blocks(spark):
    context = "free\n[p. 1]\nabc\n\n[p. 2]\ndef\n[p. 1]\nx"
    assert matching.blocks(context) == [(0, "free"), (1, "abc"), (2, "def"), (1, "x")]
    native = _column(spark, [context, ""], matching.block_array)
    assert [(b.page, b.text) for b in native[0]] == matching.blocks(context) and native[1] == []


def _subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def _windows(m, n):
    return [(i, i + m) for i in range(n - m + 1)] + [(0, e) for e in range(1, m)] + [(s, n) for s in range(n - m + 1, n)]


@given(st.text("abc ", min_size=1, max_size=9), st.text("abcd ", min_size=1, max_size=25))
def test_similarity_against_brute_force(a, b):
    assert similarity.ratio(a, b) == pytest.approx(2 * _subsequence(a, b) / (len(a) + len(b)))
    a, b = sorted((a, b), key=len)
    best = max(2 * _subsequence(a, b[s:e]) / (len(a) + e - s) for s, e in _windows(len(a), len(b)))
    assert similarity.best_window(a, b).score == pytest.approx(best)


def test_ratio_is_not_levenshtein():
    assert similarity.ratio("kitten", "sitting") == pytest.approx(8 / 13)


@pytest.mark.parametrize(
    ("raw", "status", "first_try", "repairs"),
    [
        (CARD, "ok", True, []),
        (f"```json\n{CARD}\n```", "repaired", False, [completion.FENCES]),
        (f"Sure: {CARD} done", "repaired", False, [completion.OBJECT]),
        (CARD.replace("3}", "3,}"), "repaired", False, [completion.COMMA]),
        (CARD.replace("3}", '"p. 3"}'), "repaired", False, [completion.PAGE]),
        (CARD.replace("3}", "3.0}"), "repaired", False, [completion.PAGE]),
        (CARD.replace("null", '"N/A"'), "repaired", True, [completion.SENTINEL]),
        (CARD.replace('"limitacao":null,', ""), "repaired", True, [completion.MISSING]),
        (f'{{"ficha":{CARD}}}', "repaired", False, [completion.ENVELOPE]),
        (CARD[:60], "failed", False, []),
        ("no object", "failed", False, []),
        ("[1]", "failed", False, []),
        (None, "failed", False, []),
        (CARD.replace("twenty characters at least", "short"), "failed", False, []),
        (CARD.replace("}}", '},"extra":1}'), "failed", False, []),
    ],
)
def test_parse(raw, status, first_try, repairs):
    p = completion.parse(raw)
    assert (p.status, p.first_try, p.repairs, p.card is None) == (status, first_try, repairs, status == "failed")


@given(st.text(max_size=80))
def test_parse_is_total(raw):
    assert completion.parse(raw).status in ("ok", "repaired", "failed")


def test_parsed_column(spark):
    got = _column(spark, [CARD, "x", None], completion.parsed)
    assert [g.status for g in got] == ["ok", "failed", "failed"] and got[0].card.evidence.page == 3


def test_candidate_windows_lose_none():
    """Best windows by the index of pieces equal those of all windows, ties and places included, and far fewer are compared."""
    r = random.Random(12)
    compared = every = 0
    for _ in range(1500):
        letters = r.choice(["ab", "abcdef", "abcdefghij klmnop", "é日ab "])
        m, n = r.choice([1, 2, 5, 12, 20, 60, 90]), r.choice([0, 1, 3, 50, 200, 500])
        text_ = "".join(r.choices(letters, k=n))
        needle = list(text_[(i := r.randrange(n - m)) : i + m]) if n > m and r.random() < 0.6 else r.choices(letters, k=m)
        for _ in range(r.randrange(max(2, m // 8))):
            k = r.randrange(len(needle) + 1)
            needle[k : k + r.randrange(2)] = r.choices(letters, k=r.randrange(2))
        needle, cutoff = "".join(needle), r.choice([0.5, 0.7, 0.8, 0.9, 0.95])
        whole, indexed = similarity.Text(text_), similarity.Text(text_)
        best = similarity.best_window(needle, whole)
        assert similarity.best_window(needle, indexed, cutoff) == (best if best.score >= cutoff or not needle else similarity.NONE)
        if cutoff >= 0.9 and len(letters) > 10:
            compared, every = compared + indexed.compared, every + whole.compared
    assert compared < every / 10


def test_one_repeated_piece_makes_no_candidates():
    """A window has enough different pieces whole; many places of the same one asked for windows in vain."""
    from veritome.functions import similarity

    needle = "".join(chr(ord("A") + i) for i in range(60))
    assert not len(similarity.candidates(needle, similarity.Text(needle[:3] * 20), 0.9))
    text = similarity.Text("x" * 50 + needle[:30] + "_" + needle[31:] + "y" * 50)
    assert similarity.best_window(needle, text, 0.9) == similarity.best_window(needle, text)


def test_line_keys_look_for_two_patterns_only(spark):
    """Runs of spaces and digits; what is left at the ends is one plain space, which needs no pattern."""
    from veritome.functions import text

    rows = spark.createDataFrame([(" \t Page  12 of 3 \x1c",), ("",), (" \n ",)], "line string")
    assert [r.k for r in rows.select(text.line_key(F.col("line")).alias("k")).collect()] == ["page # of #", "", ""]
    assert str(text.line_key(F.col("line"))).count("regexp_replace") == 2


def test_strip_looks_at_the_ends_by_no_pattern(spark):
    """All kinds of white space go from both ends, those inside stay, and no pattern reads the whole text."""
    values = [text.SPACES + "a" + text.SPACES + "b" + text.SPACES, text.SPACES, "", None]
    assert _column(spark, values, text.strip) == ["a" + text.SPACES + "b", "", "", None]
    assert set(text.SPACES) == {c for c in map(chr, range(0x10000)) if c.isspace()}
    assert "regexp" not in str(text.strip(F.col("v")))


def test_bounds_for_many_needles_lose_none():
    """What reaches the cutoff, whole or in a window, at the text's ends too, is never ruled out; most others are."""
    r = random.Random(5)
    ruled_out = 0
    for _ in range(300):
        letters = "abcdefghijklmnopqrstuvwxyz "[: r.choice([3, 8, 27])]
        text_ = "".join(r.choices(letters, k=r.randrange(0, 200)))
        needles = []
        for _ in range(6):
            at, m = r.randrange(-20, len(text_) + 1), r.randrange(0, 150)
            needle = list(text_[max(0, at) : at + m]) if r.random() < 0.6 else r.choices(letters, k=m)
            for _ in range(r.randrange(max(2, m // 6))):
                k = r.randrange(len(needle) + 1)
                needle[k : k + r.randrange(2)] = r.choices(letters + "Z", k=r.randrange(2))
            needles.append("".join(needle))
        cutoff, whole = r.choice([0.7, 0.8, 0.9]), r.random() < 0.5
        for needle, able in zip(needles, similarity.may_reach(needles, text_, cutoff, whole=whole), strict=True):
            score = max(similarity.partial_ratio(needle, text_), similarity.ratio(needle, text_) if whole else 0.0)
            assert able or score < cutoff
            ruled_out += not able
    assert ruled_out > 300
