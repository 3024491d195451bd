from __future__ import annotations

import random
import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veritome.operators import chunking, cleaning, neighbours, overview, selection, spans
from veritome.operators.selection import Page
from veritome.sources import synthetic


def cleaned(spark, texts, known=None):
    """Each text's lines and what cleaning makes of them; ``known`` forms stand for its document's words."""
    rows = spark.createDataFrame([(i, t, known and known[i]) for i, t in enumerate(texts)], "i int, text string, known array<string>")
    words = F.coalesce("known", F.array().cast("array<string>"))
    found = rows.select("i", cleaning.lined(F.col("text")).alias("lines"), words.alias("known")).select("i", "lines", cleaning.cleaned(F.col("lines"), F.col("known")).alias("clean")).collect()
    return [(r.lines, r.clean) for r in sorted(found, key=lambda r: r.i)]


CLEAN = {
    "an exam-\nple here": "an example here",
    "a state-of-the-\nart model": "a state-of-the-art model",
    "Sentinel-\n2 imagery": "Sentinel-2 imagery",
    "from 2019-\n2020 data": "from 2019-2020 data",
    "soft\u00ad\nware \ufb01le": "software file",
    "a-\nb-\nc-\nd e-\nf": "ab- cd ef",
    "self-\nmade": "self-made",
    "high-\nly": "highly",
    "7\nFirst line\n42\nLast line\n8": "First line 42\n\nLast line",
    "": "",
    None: None,
}


def test_cleaned(spark):
    assert [c for _, c in cleaned(spark, CLEAN)] == [*CLEAN.values()]


def test_page_numbers_go_from_the_edges(spark):
    (lines, _), (none, _) = cleaned(spark, ["7\nFirst line\n42\nLast line\n8", "1\n\n2"])
    assert (lines, none) == ("First line\n42\nLast line", "")


def test_cleaning_is_idempotent(spark):
    r = random.Random(5)
    texts = ["".join(r.choices("ab-. \n\u00adX7é‐", k=r.randrange(60))) for _ in range(400)]
    once = [c for _, c in cleaned(spark, texts)]
    assert [c for _, c in cleaned(spark, once)] == once


def test_hyphens_follow_the_document(spark):
    got = cleaned(spark, ["fine-\ntuning", "exam-\nple", "fine-\ntuning", "Fine-\ntuning of-the-\nart"], [["fine-tuning"], ["example"], ["finetuning", "fine-tuning"], ["fine-tuning"]])
    assert [c for _, c in got] == ["fine-tuning", "example", "finetuning", "Fine-tuning of-the-art"]


def test_pages_are_cleaned_by_their_documents_words(spark):
    rows = [("a", 1, "We do fine-\ntuning here"), ("a", 2, "and fine-tuning there"), ("b", 1, "We do fine-\ntuning here"), ("b", 2, "finetuning"), ("c", 1, None), ("c", 2, "We do re-\nal work")]
    got = {(r.doc, r.page): r.text for r in cleaning.clean_pages(spark.createDataFrame(rows, "doc string, page int, text string")).collect()}
    assert got["a", 1] == "We do fine-tuning here" and got["b", 1] == "We do finetuning here" and got["c", 1] is None and got["c", 2] == "We do real work"
    plan = cleaning.clean_pages(spark.createDataFrame(rows, "doc string, page int, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert set(re.findall(r"EvalPython \[(\w+)\(", plan)) == {"edges", "_compatible"}  # keys of edge lines and compatibility forms only


def test_cleaning_leaves_texts_where_they_are(spark, monkeypatch):
    """Where no word is broken no word is read, and texts meet only keys that are sent to them; shuffled joins find the same."""
    rows = [(f"d{i % 3}", i, f"Head {i}\nbody é of many words {'abcdefghijkl'[i]}\nPage {i}") for i in range(12)]
    out = cleaning.clean_pages(spark.createDataFrame(rows, "doc string, page int, text string"))
    assert {(r.doc, r.page): r.text for r in out.collect()} == {(f"d{i % 3}", i): f"body é of many words {'abcdefghijkl'[i]}" for i in range(12)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan.replace("BroadcastExchange", "")
    broken = spark.createDataFrame([*rows, ("d0", 90, "exam-\nple"), ("d1", 91, "exam-\nple"), ("d1", 92, "the exam-ple"), ("d2", 93, None)], "doc string, page int, text string")
    sent = sorted(cleaning.clean_pages(broken).collect(), key=lambda r: r.page)
    monkeypatch.setattr(cleaning, "sent_if_few", lambda df: df)
    assert sorted(cleaning.clean_pages(broken).collect(), key=lambda r: r.page) == sent
    assert [r.text for r in sent[-4:]] == ["example", "exam-ple", "the exam-ple", None]


def test_repeated_lines(spark):
    texts = [f"Journal X\nbody {i}\nonce {'abcd'[i - 1]}\nsame inside\nmore {'abc'[i % 3]}\nend\ntail\nPage {i}" for i in range(1, 5)]
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate(texts, 1)] + [("one", 1, texts[0])], "doc string, page int, text string")
    got = {(r.doc, r.page): r.text for r in cleaning.strip_repeated_lines(df).collect()}
    assert got["one", 1] == texts[0]
    assert got["a", 1].split("\n") == ["once a", "same inside", "more b"]


@given(st.lists(st.sampled_from(["a", "bb ", ". ", "!", "\n\n", "word ", "x", '" '])), st.integers(4, 40), st.integers(0, 19))
def test_chunks_cover_the_text(parts, size, overlap):
    if not overlap < size / 2:
        return
    text = "".join(parts)
    got = chunking.chunk_offsets(text, size, overlap)
    seen = {i for a, b in got for i in range(a, b)}
    assert all(0 < b - a <= size and text[a:b] == text[a:b].strip() for a, b in got)
    assert all(x[0] < y[0] for x, y in zip(got, got[1:], strict=False))
    assert {i for i, c in enumerate(text) if not c.isspace()} <= seen


@pytest.mark.parametrize(("size", "overlap"), [(0, 0), (100, 50), (100, -1)])
def test_bad_sizes(size, overlap):
    with pytest.raises(ValueError, match="must"):
        chunking.check_sizes(size, overlap)


def test_chunk_pages_are_exact(spark):
    text = "First sentence here. Second one follows! " * 30
    df = spark.createDataFrame([("a", 1, text), ("b", 1, None), ("c", 1, "")], "doc string, page int, text string")
    rows = chunking.chunk_pages(df, 200, 40).collect()
    assert {r.doc for r in rows} == {"a"} and all(r.text == text[r.start : r.end] for r in rows)


ARTICLE = [
    Page(1, "Abstract\nWe study floods in detail here.\n\n1 Introduction\nEarlier work is old. " * 2),
    Page(2, "2 Data\nMany records. " + "word " * 90 + "\n3 Methods\nA method. However, one limitation is the small sample. " + "more " * 150),
    Page(3, "4 Limitations\nThis study is limited. We did not consider winter. " + "less " * 60),
    Page(4, "6 Conclusion\nThat is all.\n\nReferences\n[1] X\n7 Results\nnot a section"),
]


def article(spark):
    return spark.createDataFrame([("d", p.page, p.text) for p in ARTICLE], "doc string, page int, text string")


def marks(spark, how):
    row = selection._marked(article(spark), how).first().asDict(recursive=True)
    return selection._marks(row["heads"], row["references"], row["cues"])


def test_headings_stop_at_references(spark):
    found = selection.Outline(ARTICLE, marks(spark, selection.Keyword()))
    assert [h.label for h in found.headings] == ["Abstract", "2 Data", "3 Methods", "4 Limitations", "6 Conclusion"]


@pytest.mark.parametrize("budget", [150, 400, 900, 5000])
def test_hybrid_keeps_its_budget(spark, budget):
    how = selection.Hybrid(max_chars=budget)
    chosen, params = how.select(ARTICLE, marks(spark, how))
    assert params["chars_by_source"]["cues"] and sum(s.end - s.start for s in chosen) == sum(params["chars_by_source"].values()) <= budget
    assert all(a.page < b.page or (a.page == b.page and a.end < b.start) for a, b in zip(chosen, chosen[1:], strict=False))


def test_keyword_takes_the_first_of_each_section_and_the_opening_without_an_abstract(spark):
    how = selection.Keyword()
    spans_, params = how.select(ARTICLE, marks(spark, how))
    assert params["sections_selected"] == ["Abstract", "4 Limitations", "3 Methods", "2 Data", "6 Conclusion"] and params["fallback"] is None
    later = selection.Marks([h for h in marks(spark, how).heads if h.page > 1])
    assert how.select(ARTICLE, later)[1]["sections_selected"][:2] == ["início do artigo", "4 Limitations"]
    assert how.select(ARTICLE, selection.Marks())[1]["fallback"] == "first_pages(2)"


def test_strategies(spark):
    pages = spark.createDataFrame([("d", p.page, p.text) for p in ARTICLE] + [("blank", 1, " "), ("null", 1, None)], "doc string, page int, text string")
    for name in selection.STRATEGIES:
        rows = {r.doc: r for r in selection.select_contexts(pages, selection.strategy(name)).collect()}
        assert set(rows) == {"d", "blank", "null"} and rows["d"].chunks and not rows["null"].chunks
        assert all(dict(ARTICLE)[c.page][c.start : c.end] == c.text for c in rows["d"].chunks)
    with pytest.raises(ValueError, match="unknown"):
        selection.strategy("other")
    first = selection.select_contexts(pages, selection.FirstPages(1)).filter("doc = 'd'").select(selection.rendered(F.col("chunks")).alias("t")).first().t
    assert first == f"[p. 1]\n{ARTICLE[0].text.strip()}"


def test_limitation_recall(spark):
    pages = synthetic.corpus(spark, 4)
    table = {r.strategy: r for r in overview.recall_of(pages, {"all": selection.FirstPages(4), "one": selection.FirstPages(1)}).collect()}
    assert table["all"].recall == 1.0 and table["all"].docs_with_sentences == 2 and table["one"].in_context == 0


def test_merge_spans(spark):
    df = spark.createDataFrame([("a", 0, 5, 0.1, "x"), ("a", 5, 9, 0.3, "y"), ("a", 11, 12, 0.2, "z"), ("b", 1, 2, None, "w")], "k string, start int, end int, score double, label string")
    got = {tuple(r) for r in spans.merge_spans(df, ["k"], score="score", label="label").collect()}
    assert got == {("a", 0, 9, 2, 0.3, "y"), ("a", 11, 12, 1, 0.2, "z"), ("b", 1, 2, 1, None, "w")}


def test_fitting_skips_and_goes_on(spark):
    df = spark.createDataFrame([("a", 1, 60), ("a", 2, 50), ("a", 3, 40), ("b", 1, 200)], "k string, i int, size int")
    assert {(r.k, r.i) for r in spans.fitting(df, ["k"], "size", [F.col("i")], 100).collect()} == {("a", 1), ("a", 3)}


def plain_fitting(rows, budget):
    used, taken = {}, set()
    for k, i, size in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        if size is not None and used.get(k, 0) + size <= budget:
            used[k] = used.get(k, 0) + size
            taken.add((k, i))
    return taken


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_fitting_in_blocks_equals_the_plain_pass(spark, block):
    r = random.Random(6)
    rows = [(r.choice(["a", "b", "c", None]), i, r.choice([1, 3, 20, 60, 200, None])) for i in range(300)] + [("z", 1, 500), ("y", 1, 100)]
    df = spark.createDataFrame(rows, "k string, i int, size int").repartition(3)
    got = spans.fitting(df, ["k"], "size", [F.col("i")], 100, block=block)
    assert got.columns == ["k", "i", "size"] and {(x.k, x.i) for x in got.collect()} == plain_fitting(rows, 100)
    assert spans.fitting(df.limit(0), ["k"], "size", [F.col("i")], 100).count() == 0


def test_fitting_splits_a_key_of_a_million_rows(spark):
    df = spark.range(1_000_000).select(F.lit("hot").alias("k"), F.col("id").alias("i"), (F.pmod(F.xxhash64("id"), F.lit(900)) + 100).alias("size"))
    rows = [("hot", r.i, r.size) for r in df.filter("i < 20000").collect()]
    got = {(x.k, x.i) for x in spans.fitting(df, ["k"], "size", [F.col("i")], 5000).collect()}
    want = plain_fitting(rows, 5000)
    left = 5000 - sum(size for k, i, size in rows if (k, i) in want)
    assert left < 100 and got == want  # nothing fits after the rows looked at here


def plain_uncovered(rows):
    owner = {}
    for k, start, end, rank, i in sorted(rows, key=lambda r: (r[3], r[4])):
        for p in range(start, end):
            owner.setdefault((k, p), i)
    return {i: sum(o == i for o in owner.values()) for *_, i in rows}


def test_uncovered_equals_the_plain_count(spark):
    r = random.Random(8)
    rows = [("hot" if r.random() < 0.7 else r.choice("ab"), s, s + r.choice([0, 1, 5, 255, 256, 257, 700]), r.randrange(4), i) for i in range(250) for s in [r.randrange(-600, 1500)]]
    df = spark.createDataFrame(rows, "k string, start int, end int, rank int, i int").repartition(3)
    got = spans.uncovered(df, ["k"], [F.col("rank"), F.col("i")])
    assert got.columns == [*df.columns, "fresh"] and {x.i: x.fresh for x in got.collect()} == plain_uncovered(rows)
    assert spans.uncovered(df.limit(0), ["k"], [F.col("i")]).count() == 0


def test_top_chunks_beyond_one_block(spark):
    vec = lambda i: [float((i * 37 + j * 11) % 19 - 9) for j in range(4)]
    chunks = spark.createDataFrame([(f"d{i % 3}", i, vec(i)) for i in range(60)], "doc string, chunk long, vector array<float>")
    queries = spark.createDataFrame([(i, f"q{i}", vec(i)) for i in range(25)], "query long, label string, vector array<float>")
    once = spans.top_chunks(chunks, queries, 2)
    in_blocks = spans.top_chunks(chunks, queries, 2, max_queries=4)
    assert sorted(map(tuple, in_blocks.collect())) == sorted(map(tuple, once.collect()))


def plain_top_chunks(chunks, queries, k):
    """As the SQL reads: each pair a sum in the vector's order; null where it is unknown, and last."""
    best = {}
    for label, q, v in queries:
        for doc, c, w in chunks:
            known = v is not None and w is not None and len(v) == len(w) and None not in (*v, *w)
            best.setdefault((doc, q), []).append((sum((np.float64(np.float32(a)) * np.float64(np.float32(b)) for a, b in zip(w, v, strict=True)), np.float64(0)) if known else None, c, label))
    out = {}
    for (doc, q), rows in best.items():
        for s, c, label in sorted(rows, key=lambda r: (r[0] is None, r[0] is not None and not np.isnan(r[0]), -np.nan_to_num(r[0]) if r[0] is not None else 0, r[1]))[:k]:
            out.setdefault((doc, c), []).append(((s is not None, s is not None and bool(np.isnan(s)), np.nan_to_num(s) if s is not None else 0, -q), s, label))
    top = {key: max(x, key=lambda t: t[0]) for key, x in out.items()}
    return {key: (repr(round(float(s), 6)) if s is not None else None, label) for key, (_, s, label) in top.items()}


def test_top_chunks_in_cells_equal_the_plain_sums(spark, monkeypatch):
    """Copies tie exactly wherever they lie; null, short and odd vectors keep their places; pairs never become rows of a join."""
    monkeypatch.setattr(spans, "SHARD", 64)
    monkeypatch.setattr(spans, "CELL", 256)
    r = random.Random(5)
    vec = lambda: [r.gauss(0, 1) for _ in range(7)]
    hot = vec()
    chunks = [(r.choice(["a", "b", None]), i, hot if i % 3 == 0 else vec()) for i in range(240)]
    chunks += [("a", 900, None), ("b", 901, hot[:3]), ("c", 902, None), ("c", 903, hot), ("b", 904, [*hot[:6], None]), ("b", 905, [float("nan"), *hot[1:]]), ("d", 906, [])]
    queries = [(f"q{i}", i, hot if i % 5 == 0 else vec()) for i in range(30)] + [("none", 50, None), ("short", 51, hot[:3])]
    held = spark.createDataFrame(chunks, "doc string, chunk long, vector array<float>").repartition(5)
    asked = spark.createDataFrame(queries, "label string, query long, vector array<float>")
    near = spans.top_chunks(held, asked, 4, max_queries=9)
    got = {(x.doc, x.chunk): (None if x.score is None else repr(x.score), x.label) for x in near.collect()}
    assert got == plain_top_chunks(chunks, queries, 4)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert spans.top_chunks(held.limit(0), asked, 4).count() == 0 == spans.top_chunks(held, asked.limit(0), 4).count()
    assert near.schema == spans.top_chunks(held.limit(0), asked, 4).schema


def exact_neighbours(rows, queries, k):
    x = np.array([v for _, v in rows], np.float32).astype(np.float64)
    out = set()
    for q, v in queries:
        s = x @ np.array(v, np.float32).astype(np.float64)
        out |= {(q, rows[i][0]) for i in np.lexsort(([r[0] for r in rows], -s))[:k]}
    return out


def test_neighbours_recall_on_the_standard_vectors(spark):
    """Recall at 6 of the inverted file against all pairs, and exactness once every list is looked into."""
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    rows = [(r.id, r.vector) for r in e.collect()]
    want = exact_neighbours(rows, [r for r in rows if r[0] % 10 == 0], 6)
    got = {(r.query, r.id) for r in neighbours.nearest(e, e.filter("id % 10 = 0"), 6).collect()}
    assert len(got) == len(want) and len(got & want) / len(want) >= 0.9
    whole = {(r.query, r.id) for r in neighbours.nearest(e, e.filter("id % 10 = 0"), 6, lists=neighbours.fit(e, 6)._replace(probes=10_000)).collect()}
    assert len(whole & want) / len(want) > 0.999  # but for products that differ in their last bits


def test_neighbours_of_hot_lists_nulls_and_nothing(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CAP", 16)
    r = random.Random(9)
    rows = [(i, [1.0, 0.01 * r.randrange(100), 0.0]) for i in range(200)] + [(500 + i, [0.0, 0.0, 1.0]) for i in range(5)]
    df = spark.createDataFrame([*rows, (900, None)], "id long, vector array<float>").repartition(3)
    got = {(x.query, x.id) for x in neighbours.nearest(df, df.filter("id % 4 = 0"), 3, lists=neighbours.Lists(np.eye(3, dtype=np.float32), 1)).collect()}
    asked = [x for x in rows if x[0] % 4 == 0]
    assert got == exact_neighbours(rows, asked, 3)
    assert neighbours.nearest(df.limit(0), df, 3).count() == 0 == neighbours.nearest(df, df.limit(0), 3).count()


def test_vectors_equal_the_plain_count_in_any_company():
    """Each feature by itself, as the definition reads; a text's vector doesn't depend on those beside it."""
    from zlib import crc32

    from veritome.operators import embedding

    r = random.Random(11)
    texts = ["", "the of", "Ação ﬁel x́ý ℡ aaaaaaaa", *("".join(r.choices("ab <>-9éÉ\n", k=r.randrange(400))) for _ in range(150))]
    for text, got in zip(texts, embedding.vectors(texts), strict=True):
        want = np.zeros(embedding.DIM, np.float32)
        for f, n in embedding.features(text).items():
            h = crc32(f.encode())
            want[h % embedding.DIM] += np.float32((1.0 if h >> 31 else -1.0) * (1.0 + np.log(float(n))))
        norm = float(np.linalg.norm(want))
        assert np.array_equal(got, want / norm if norm else want)


def test_budgets_share_marks_and_candidates(spark, monkeypatch):
    """Each budget's contexts are those of its own selection, though a document is marked once."""
    pages = synthetic.corpus(spark, 3)
    base, budgets = selection.Hybrid(), {"tight": 600, "none": None}
    alone = {(name, c.doc): (c.chunks, c.params) for name, b in budgets.items() for c in selection.select_contexts(pages, selection.Hybrid(max_chars=b)).collect()}
    assert {(c.strategy, c.doc): (c.chunks, c.params) for c in selection.select_under(pages, base, budgets).collect()} == alone
    calls, plain = [], selection.sections.headings
    monkeypatch.setattr(selection.sections, "headings", lambda *a: calls.append(1) or plain(*a))
    overview.budget_curve(pages, base, (600, 1200, None))
    assert len(calls) == 1
