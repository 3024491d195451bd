from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from veritome.llm import mixing

DOCS = "doc_id long, text string, source string, skey string, row int"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute_targets(sizes, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, out, live = Fraction(3, 2) * sum(sizes.values()), {}, set(order)
    while live:
        level = left / sum(w[s] for s in live)
        full = {s for s in live if w[s] * level > 2 * sizes[s]}
        if not full:
            return out | {s: w[s] * level for s in live}
        for s in full:
            out[s] = Fraction(2 * sizes[s])
            left -= out[s]
        live -= full
    return out


def brute_mix(rows):
    size = lambda r: len(words(r[1]))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += size(r)
    targets, places, packets = brute_targets(sizes), [], []
    for s in sizes:
        queue = sorted((r for r in rows if r[2] == s), key=lambda r: (hashlib.md5(f"mix:{'' if r[0] is None else r[0]}".encode()).hexdigest(), -1 if r[0] is None else r[0], size(r)))
        start = 0
        for r in queue:
            for epoch in range(2):
                for k in range(0, size(r), mixing.PACKET):
                    done = min(size(r), k + mixing.PACKET)
                    packets.append((float(start + done + epoch * sizes[s]) / float(targets[s]), "" if s is None else "=" + s, epoch, start + k, done - k, len(places)))
            places.append((r[0], size(r), sizes[s], float(targets[s])))
            start += size(r)
    left, taken = sum(sizes.values()) * 3 // 2, Counter()
    for *_, n, place in sorted(packets):
        taken[place] += min(n, left)
        left -= min(n, left)
    return sorted(((*p, taken[i]) for i, p in enumerate(places)), key=str)


def rows(n=300):
    out = [(i, " ".join(["w"] * (i * 37 % 50)), ["hot", "b", "é", None, "tiny"][0 if i % 3 else i % 5], "k", 1) for i in range(n)]
    return out + [(None, "null id", "b", "k", 1), (7000, None, "b", "k", 1), (7001, "", "none", "k", 1), (7002, "x " * 20_000, "b", "k", 1), (7, "again", "b", "k", 1)]


def test_against_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, DOCS)
    got = mixing.fair_mix(df)
    out = sorted(((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got.collect()), key=str)
    assert [x[:3] + x[4:] for x in out] == [x[:3] + x[4:] for x in brute_mix(data)]
    assert [x[3] for x in out] == pytest.approx([x[3] for x in brute_mix(data)])
    by_source = defaultdict(lambda: [0, 0.0])
    for r in got.collect():
        by_source[r.skey][0] += r.taken
        by_source[r.skey][1] = r.target
        assert 0 <= r.taken <= 2 * r.size
    assert sum(a for a, _ in by_source.values()) == sum(len(words(r[1])) for r in data) * 3 // 2
    assert all(abs(a - b) <= mixing.PACKET for a, b in by_source.values())
    again = mixing.fair_mix(df.repartition(13))
    assert sorted((str(r.doc_id), r.size, r.taken) for r in again.collect()) == sorted((str(r.doc_id), r.size, r.taken) for r in got.collect())


def test_the_cut_is_one_place_in_the_global_order(spark):
    """What is served finishes before what isn't, over all sources."""
    got = mixing.fair_mix(spark.createDataFrame([r for r in rows() if r[0] != 7002], DOCS)).collect()
    whole = [r.virtual_finish for r in got if r.size and r.taken >= r.size]
    unserved = [r.virtual_finish for r in got if r.size and not r.taken]
    assert not unserved or max(whole) <= min(unserved)
    twice = [(r.start + r.size + r.source_size) / r.target for r in got if r.size and r.taken == 2 * r.size]
    assert twice and (not unserved or max(twice) <= min(unserved))


def test_hot_null_ids_and_repeated_rows(spark):
    data = [(None, "a b c", "hot", "k", i) for i in range(400)] + [(5, "x y", "hot", "k", i) for i in range(300)] + [(1000 + i, "w " * 9, "b", "k", 1) for i in range(60)]
    got = mixing.fair_mix(spark.createDataFrame(data, DOCS)).collect()
    brute = brute_mix(data)
    assert Counter((r.doc_id, r.size, r.taken) for r in got) == Counter((x[0], x[1], x[4]) for x in brute)


def test_documents_follow_the_plan(spark):
    df = spark.createDataFrame([r for r in rows() if r[0] != 7], DOCS)
    taken = Counter()
    for r in mixing.fair_mix(df).collect():
        taken[r.doc_id] += r.taken
    out = mixing.mix_documents(df)
    assert out.columns == df.columns
    got, copies = Counter(), Counter()
    for r in out.collect():
        got[r.doc_id] += len(words(r.text))
        copies[r.doc_id] += 1
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in got.items() if v} and max(copies.values()) == 2


def test_empty_and_wordless(spark):
    assert mixing.fair_mix(spark.createDataFrame([], DOCS)).count() == 0
    got = mixing.fair_mix(spark.createDataFrame([(1, None, None, "", 1), (2, " ", "a", "", 1)], DOCS)).collect()
    assert all(r.taken == 0 and r.target == 0 and r.virtual_finish is None for r in got)
    assert mixing.mix_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_whole_documents_stay_whole(spark):
    data = [(i, f"t{i} " + "w " * (i * 37 % 50), "ab"[i % 2], "k", 1) for i in range(200)] + [(999, "v " * 5000, "b", "k", 1)]
    df = spark.createDataFrame(data, DOCS)
    texts = {r[0]: r[1] for r in data}
    got = mixing.mix_documents(df, whole=True).collect()
    assert all(r.text == texts[r.doc_id] for r in got)
    cut = mixing.mix_documents(df).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in cut)
    assert any(r.text != texts[r.doc_id] for r in cut)


def test_pipeline_mixes_whole_documents(spark):
    import corpus_pipeline

    data = [(i, f"t{i} " + "w " * (i * 37 % 50), "ab"[i % 2], "k", 1) for i in range(200)]
    texts = {r[0]: r[1] for r in data}
    assert all(r.text == texts[r.doc_id] for r in corpus_pipeline.mix(spark, spark.createDataFrame(data, DOCS), "").collect())
