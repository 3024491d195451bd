from __future__ import annotations

import math
import random
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritome.llm import language_id, lexical_search, merkle

# ---------------------------------------------------------------- ranked search
DOCS = "doc_id long, text string, n long, terms string, _item int"
ITEMS = "item_id long, text string, score double"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def plain_terms(text):
    return TERM.findall((text or "").translate(UPPER))


def plain_search(docs, items, k=50):
    docs = [(i, plain_terms(t)) for i, t in docs]
    docs = [(i, t) for i, t in docs if t]
    n_docs, n_terms = len(docs), sum(len(t) for _, t in docs)
    df = Counter(t for _, ts in docs for t in set(ts))
    out = []
    for item, text in items:
        scored = []
        for i, ts in docs:
            tf, m = Counter(ts), 50 + (50 * len(ts) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in set(plain_terms(text)) if t in tf)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def searched(spark, docs, items, **options):
    found = lexical_search.search(spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], DOCS).repartition(3), spark.createDataFrame([(i, t, 0.5) for i, t in items], ITEMS), **options)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def made_docs(n, seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Äé", "STRASSE", "Straße", "x_y", "a\x00b"]
    return [(i, r.choice([" ", ", ", "\n"]).join(r.choices(vocabulary, weights=range(len(vocabulary), 0, -1), k=r.choice([0, 1, 5, 40, 300])))) for i in range(n)]


def test_search_equals_brute_force_in_any_blocks(spark):
    docs = [*made_docs(250), (7, "w1 w2"), (7, "w1 w2"), (None, "w1 w2"), (900, None), (901, ""), (902, "!? _"), (903, "w3 " * 500_000)]
    items = [(1, "W1 w2, w59 w1"), (1, "W1 w2, w59 w1"), (2, None), (3, "nowhere"), (4, " ".join(f"w{i}" for i in range(60))), (None, "Äé x")]
    want = plain_search(docs, items)
    assert searched(spark, docs, items) == want
    assert searched(spark, docs, items, max_pairs=1) == want
    assert searched(spark, docs, items, k=3) == plain_search(docs, items, 3)


def test_search_ties_go_to_the_smallest_ids(spark):
    docs = [(i, "same words here") for i in range(400, 0, -1)] + [(1000, "other"), (None, "same words here"), (1001, "more"), (1002, "else")] + [(2000 + i, "filler text") for i in range(500)]
    found = searched(spark, docs, [(5, "words")])
    assert [r[2] for r in sorted(found, key=lambda r: r[1])] == [*range(1, 51)]


def test_search_of_empty_tables(spark):
    assert searched(spark, [], [(1, "a")]) == [] == searched(spark, [(1, "a")], []) == searched(spark, [(1, None)], [(1, "a")])


def test_terms_in_pieces(monkeypatch):
    text = "Ab-cd éé\x7f" * 50 + "x" * 300 + " end"
    monkeypatch.setattr(lexical_search, "PIECE", 16)
    assert [t.decode() for p in lexical_search.terms(text) for t in p] == plain_terms(text)


def test_radix_order_and_sums():
    r = np.random.default_rng(3)
    keys = r.integers(0, 1 << 40, 5000).astype(np.uint64)
    assert (lexical_search.radix_order(keys) == np.argsort(keys, kind="stable")).all()
    item, doc, impact = r.integers(0, 9, 4000), r.integers(0, 50, 4000), r.integers(0, 10**12, 4000)
    want = Counter()
    for i, d, x in zip(item.tolist(), doc.tolist(), impact.tolist(), strict=True):
        want[i, d] += x
    assert [*zip(*(a.tolist() for a in lexical_search.summed(item, doc, impact, 50)), strict=True)] == [(i, d, s) for (i, d), s in sorted(want.items())]


# ---------------------------------------------------------------- Merkle manifest
ROWS = "doc_id long, source string, lang string, n_chars long, text string, tree string, at long, digest string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes):
    """Root, and siblings (left, right) of each node, level by level."""
    paths, place = [[] for _ in nodes], [*range(len(nodes))]
    while len(nodes) > 1:
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        for path, p in zip(paths, place, strict=True):
            run = runs[p // 3]
            path.append(("".join(run[: p % 3]), "".join(run[p % 3 + 1 :])))
        nodes, place = [h(*r) for r in runs], [p // 3 for p in place]
    return nodes[0], paths


def plain_manifest(rows):
    leaf = lambda *v: h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in v))
    by_source = {}
    for r in rows:
        changed = r[0] is not None and crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
        other = leaf(*r[:4], r[4].replace("\n", "")) if changed else leaf(*r)
        by_source.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(*r), r[0], other))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(by_source[s])]) for s in sources}
    root, tops = plain_tree([trees[s][0] for s in sources])
    out = []
    for s, top in zip(sources, tops, strict=True):
        for x, path in zip(sorted(by_source[s]), trees[s][1], strict=True):
            folded = x[4]
            for left, right in path + top:
                folded = h(left, folded, right)
            out.append((x[3], x[2], trees[s][0], root, h(*(left + right for left, right in path + top)), folded, folded == root))
    return sorted(out, key=str)


def manifested(spark, rows):
    docs = spark.createDataFrame([(*r, "a", 1, "b") for r in rows], ROWS).repartition(3)
    changed = F.crc32(F.encode(docs["doc_id"].cast("string"), "UTF-8")) % 2 == 0
    found = merkle.manifest(docs, tampered=(changed, F.replace(docs["text"], F.lit("\n"), F.lit(""))))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_manifest_equals_brute_force(spark):
    rows = [(i, f"s{i % 4}", "en", i, f"text\n{i}") for i in range(40)]
    rows += [(None, None, None, None, None), (None, "é", "fr", 0, ""), (3, "lone", "en", 1, "a\n"), (5, "s1", "en", 5, "another"), (5, "s1", "en", 5, "another"), (6, "", "de", 2, "x" * 1_000_000 + "\n"), (-7, "Z", "de", 2, "ü\n")]
    assert manifested(spark, rows) == plain_manifest(rows)


def test_manifest_of_sources_larger_than_a_block(spark):
    n = merkle.ARITY**merkle.HEIGHT
    rows = [(i, "hot", "en", 1, f"t\n{i}") for i in range(2 * n + 1)] + [(i, "whole", "en", 1, "t") for i in range(n)] + [(1, "small", "en", 1, "\n")]
    assert manifested(spark, rows) == plain_manifest(rows)


@pytest.mark.parametrize("rows", [[], [(1, "a", "en", 1, "x\n")], [(1, "a", "en", 1, "x\n"), (2, "b", "en", 1, None)]])
def test_manifest_of_few_rows(spark, rows):
    assert manifested(spark, rows) == (plain_manifest(rows) if rows else [])


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27])
def test_climb_is_the_plain_tree(n):
    nodes = [h(str(i)) for i in range(n)]
    assert merkle.climb(nodes, merkle.levels_of(n)) == plain_tree(nodes)


# ---------------------------------------------------------------- language identification
WORDS = {"en": "the of and to in is that it was for on are with as his they at be this from".split(), "fr": "le de un être et à il avoir ne je son que se qui ce dans en du elle au".split(), "": "ja nej och att det som en på är av för med till den har".split()}
LEARN = "doc_id long, text string, lang string, score double, lang_pred string"


@pytest.fixture(scope="module")
def taught(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choices(WORDS[lang], k=r.choice([3, 20, 200]))), lang, 0.1, "x") for i in range(360) for lang in [[*WORDS][i % 3]]]
    rows += [(1000, None, "en", 0.1, "x"), (1001, "le le le", None, 0.1, "x"), (1002, "12 34", "de", 0.1, "x"), (1003, "", "xx", 0.1, "x"), (1, "le et un " * 9, "fr", 0.1, "x")]
    docs = spark.createDataFrame(rows, LEARN)
    return docs, language_id.fit(docs, learned=docs["doc_id"] % 4 != 2)


def test_held_out_languages_are_told(taught):
    docs, net = taught
    assert net.languages == ["", "en", "fr"]  # neither what has no letter nor a null is learned
    found = {r["doc_id"]: r for r in language_id.identify(docs.filter("doc_id < 360"), net).collect()}
    told = [(docs_row["lang"], found[docs_row["doc_id"]]["lang_pred"]) for docs_row in docs.filter("doc_id < 360 and doc_id % 4 = 2").collect()]
    assert np.mean([a == b for a, b in told]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_undetermined_and_long_texts(spark, taught):
    _, net = taught
    texts = [None, "", " 12 %\n", "the of and", "the of and", "le de un être " * 40_000, "x", "日本", "\x00 the"]
    rows = language_id.identify(spark.createDataFrame([(i, t, "zz", 0.0, "q") for i, t in enumerate(texts)], LEARN), net).collect()
    said = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows}
    assert [said[i] for i in range(3)] == [("und", 0.0)] * 3
    assert said[3] == said[4] and said[3][0] == "en" and said[5][0] == "fr" and said[7][0] in net.languages


def test_every_window_counts(taught):
    _, net = taught
    late = "the of and to in " * 3 + "le et un il qui dans elle " * 400
    assert language_id.judged(net, [late])[0] == ["fr"]
    rows, n = language_id.windows(["é" * 200, "", "a"])
    assert n.tolist() == [4, 0, 1] and rows.shape == (5, language_id.WINDOW) and rows[:4].tobytes().rstrip(b"\0") == ("é" * 200).encode()


def test_network_equals_a_plain_one(taught):
    _, net = taught
    rows, _ = language_id.windows(["the of le un " * 30, "x"])
    for row, got in zip(rows, language_id.probabilities(net, rows), strict=True):
        padded = np.concatenate([net.embedding[row], np.zeros((4, language_id.EMBEDDED))])
        kept = []
        for f in range(net.filters.shape[1]):
            width = language_id.WIDTHS[f // language_id.FILTERS]
            kernel = net.filters[: width * language_id.EMBEDDED, f].reshape(width, -1)
            kept.append(max(0, max((padded[i : i + width] * kernel).sum() for i in range(language_id.WINDOW)) + net.bias[f]))
        e = np.exp(np.array(kept) @ net.out + net.out_bias)
        assert np.allclose(got, e / e.sum(), atol=1e-4)


def test_nothing_to_learn_and_empty_tables(spark, taught):
    docs, net = taught
    assert language_id.fit(docs.limit(0)) is None
    assert language_id.identify(docs.limit(0), net).collect() == []
    assert {r["lang_pred"] for r in language_id.identify(docs, None).collect()} == {"und"}
