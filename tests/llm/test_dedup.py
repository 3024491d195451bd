from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from veritome.llm import common, exact_dedup, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCS)


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[lower(t)]
        known = [x for x in ids if x is not None]
        out.append((i, max(known) if known else None, len(ids), hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(1, "Same text"), (2, "same TEXT"), (3, "same text!"), (4, None), (5, ""), (6, "É"), (7, "é"), (8, "x" * 300 + "a"), (9, "x" * 300 + "b"), (10, "X" * 300 + "A"), (None, "same text"), (None, "alone"), (11, "lo ng " * 50_000)]


def test_exact_against_brute_force(spark):
    rows = ROWS + [(i, f"word {i % 40}") for i in range(100, 400)]
    got = exact_dedup.exact_dedup(frame(spark, rows), digest_all=True).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.digest) for r in got), key=str) == brute_exact(rows)
    groups = {}
    for r in got:
        groups.setdefault(r.digest, []).append(r)
    assert all(sum(r.kept for r in g) == 1 for g in groups.values())
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_digests_only_for_survivors(spark):
    got = {r.doc_id: r.digest for r in exact_dedup.exact_dedup(frame(spark, ROWS)).collect()}
    assert got[1] and got[8] and got[11] is None  # alone by length


def test_exact_with_repeated_rows_and_saturated_filter(spark, monkeypatch):
    monkeypatch.setattr(common, "MAX_WORDS", 1)
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "a"), (3, "c"), (3, "c")]
    got = exact_dedup.exact_dedup(frame(spark, rows), digest_all=True).collect()
    assert sorted((r.doc_id, r.kept) for r in got) == [(1, False), (1, False), (1, True), (2, False), (2, True), (3, False), (3, True)]
    kept = exact_dedup.drop_copies(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, "b"), (2, "a"), (3, "c")]


@pytest.mark.parametrize("drop", [exact_dedup.drop_copies, simhash.drop_near_duplicates])
def test_dropping_keeps_all_columns(spark, drop):
    df = spark.createDataFrame([(1, "a b c d", 7, "x"), (2, "A b c d", 8, "y"), (3, "other words stand here", 9, "z")], "doc_id long, text string, _hit int, `_id.key` string")
    out = drop(df)
    assert out.columns == df.columns
    keep = 2 if drop is exact_dedup.drop_copies else 1
    assert sorted((r[0], r[2]) for r in out.collect()) == sorted({(keep, 6 + keep), (3, 9)})
    assert drop(df.limit(0)).count() == 0


def test_empty_tables(spark):
    none = frame(spark, [])
    assert exact_dedup.exact_dedup(none).count() == 0 and simhash.near_duplicates(none).count() == 0


def brute_fingerprint(t):
    words = lower(t).encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@given(st.text(max_size=80))
def test_fingerprints(t):
    assert simhash.fingerprint(t) == brute_fingerprint(t)


def brute_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@settings(max_examples=30)
@given(st.integers(0, 10**6), st.integers(2, 60), st.integers(1, 6))
def test_forest_against_brute_force(seed, n, bits):
    r = random.Random(seed)
    base = r.getrandbits(64)
    fps = list({base ^ sum(1 << b for b in r.sample(range(16), r.randrange(bits + 1))) for _ in range(n)})
    small, root = simhash.forest(np.zeros(len(fps), int), np.array(fps, np.uint64), tile=4)
    up = dict(zip(small.tolist(), root.tolist(), strict=True))
    got = [up.get(f, f) for f in fps]
    want = brute_components(fps)
    same = lambda x: {frozenset(i for i, y in enumerate(x) if y == z) for z in x}
    assert same(got) == same(want)


@pytest.mark.parametrize("tile", [3, 16, 256])
def test_tiles_hold_many_groups_and_skip_far_counts(tile):
    r = random.Random(tile)
    groups, fps = [], []
    for g, n in enumerate([1, 2, 3, 90, 2, 1, 400, 5]):
        base = r.getrandbits(48) << 16
        own = {base | r.getrandbits(16) for _ in range(n)}
        fps += own
        groups += [g] * len(own)
    tally = simhash.Tally()
    small, root = simhash.forest(np.array(groups), np.array(fps, np.uint64), tile=tile, tally=tally)
    up = dict(zip(small.tolist(), root.tolist(), strict=True))
    for g in set(groups):
        own = [f for f, x in zip(fps, groups, strict=True) if x == g]
        want, got = brute_components(own), [up.get(f, f) for f in own]
        assert [want.index(w) for w in want] == [got.index(x) for x in got]
    assert tally.compared >= -(-len(fps) // tile)
    if tile < 100:
        assert tally.skipped > 0


def test_every_shared_group_goes_through_the_tiles(monkeypatch):
    """Two fingerprints that share a key meet in a tile, however small their group."""
    seen = []
    real = simhash.forest
    monkeypatch.setattr(simhash, "forest", lambda g, f, **k: seen.append(len(f)) or real(g, f, **k))
    a, b = simhash._group_links(np.zeros(3, int), np.array([8, 9, 1 << 60], np.uint64))
    assert seen == [2] and (a.tolist(), b.tolist()) in (([8], [9]), ([9], [8]))


def test_every_near_pair_shares_a_key():
    masks = np.array(simhash.MASKS, np.uint64)
    r = random.Random(1)
    for _ in range(500):
        a = r.getrandbits(64)
        b = a ^ sum(1 << x for x in r.sample(range(64), r.randrange(3)))
        assert ((np.uint64(a) & masks) == (np.uint64(b) & masks)).any()


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for g in range(12):
        words = r.choices(vocabulary, k=r.choice([2, 5, 200, 400]))
        for _ in range(r.choice([1, 3, 25])):
            own = list(words)
            for _ in range(r.randrange(3)):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            rows.append((len(rows), " ".join(own)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1003, "one"), (None, "ONE")]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(fps)
    least = {}
    for (i, _), root in zip(rows, roots, strict=True):
        least[root] = min([x for x in (least.get(root), i) if x is not None], default=None)
    want = sorted(((i, f, least[root]) for (i, _), f, root in zip(rows, fps, roots, strict=True)), key=str)
    assert sorted(((x.doc_id, x.fp % (1 << 64), x.component_id) for x in got), key=str) == want
    kept = [x.doc_id for x in simhash.drop_near_duplicates(frame(spark, rows)).collect()]
    assert sorted(kept) == sorted(set(least.values()))


def test_decisions_beyond_a_broadcast(spark, monkeypatch):
    """Joined by shuffle, with a full filter, the same rows stay."""
    monkeypatch.setattr(common, "MAX_WORDS", 1)
    rows = [(i, f"text number {i % 40} with some words") for i in range(200)] + [(3, "text number 3 with some words")]
    real = common.apply_decisions
    monkeypatch.setattr(exact_dedup, "apply_decisions", lambda *a: real(*a, max_broadcast=0))
    kept = exact_dedup.drop_copies(frame(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept) == list(range(160, 200))


def test_a_hot_star_is_split(spark):
    links = spark.createDataFrame([(i, 0) for i in range(1, 3000)] + [(i + 1, i) for i in range(3000, 3010)], "big long, small long")
    got = {tuple(r) for r in simhash.components(links).collect()}
    assert got == {(i, 0) for i in range(1, 3000)} | {(i, 3000) for i in range(3001, 3011)}


def test_very_long_texts(spark):
    long_ = "word " * 200_000
    rows = [(1, long_), (2, long_.upper()), (3, long_ + "x")]
    assert sorted((r.doc_id, r.keep_id) for r in exact_dedup.exact_dedup(frame(spark, rows)).collect()) == [(1, 2), (2, 2), (3, 3)]
    assert {r.component_id for r in simhash.near_duplicates(frame(spark, rows)).collect()} == {1}
    assert simhash.fingerprint(long_) == brute_fingerprint(long_)


def test_long_chains_are_one_component(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(200)], "big long, small long")
    assert {tuple(r) for r in simhash.components(links).collect()} == {(i + 1, 0) for i in range(200)}
