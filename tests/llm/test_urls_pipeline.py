from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from veritome.llm import registry, url_filter

DATA = Path("/root/testdata/sf0.001")
URLS = [
    (1, "https://WWW.Example.net/en/1?x"), (2, "http://example.net/fr/1"), (3, "https://a.example.com/de/"), (4, "https://a.example.com/den"), (5, "ftp://x.org/fr/2#y"), (6, "http://net/"),
    (7, "http://net"), (8, "no scheme"), (9, None), (10, "x://"), (11, "http://notexample.com/de/"), (12, "http://q.net?a=://z.org/fr/"), (13, "http://bad.io/p"), (13, "http://bad.io/p"), (14, "http://ok.io/p"),
]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut].lower(), rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return host, path, best and best.host + best.path, best and best.verdict


def test_rules_against_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in URLS], "page_id long, url string, host string")
    outcomes = spark.createDataFrame([(13, 1)] * 3 + [(14, 0), (None, 1), (13, None)], "id long, bad int")
    got = sorted(url_filter.filter_urls(pages, outcomes).collect(), key=lambda r: r.page_id)
    for r, (i, u) in zip(got, URLS, strict=True):
        host, path, rule, verdict = brute(u)
        assert (r.page_id, r.host, r.path, r.rule) == (i, host, path, rule) and r.verdict == (verdict or "allow")
    assert url_filter.filter_urls(pages.limit(0), outcomes).count() == 0
    assert url_filter.filter_urls(pages, outcomes.limit(0)).count() == len(URLS)


def test_reputation_blocks_on_evidence_only(spark):
    """Hosts that are always bad among many that aren't are blocked, once there is enough of it."""
    pages, outcomes, i = [], [], 0
    for h in range(40):
        for _ in range(30):
            pages.append((i, f"http://h{h}.site{h % 7}.io/p"))
            outcomes.append((i, int(h < 6)))
            i += 1
    pages += [(i, "http://once.site1.io/p"), (i + 1, "http://never.site1.io/p")]
    outcomes.append((i, 1))
    rows = url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "id long, bad int")).collect()
    blocked = {r.host.split(".")[0] for r in rows if r.verdict == "block"}
    assert blocked == {f"h{h}" for h in range(6)}


def test_prior_strength_matches_simulation():
    r = np.random.default_rng(3)
    n = np.full(4000, 30)
    k = r.binomial(n, r.beta(2.0, 8.0, len(n)))
    assert url_filter.strength(k.sum(), n.sum(), len(n), float((n * n).sum()), float((k * k / n).sum())) == pytest.approx(10, rel=0.15)


def test_queries_match_their_sql(spark):
    db = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        db.execute(f"create view {t} as select * from '{DATA / t}.parquet'")
    for name, sql in registry.oracle_sql().items():
        mine = registry.queries()[name](spark, str(DATA))
        want = db.execute(sql)
        columns = [c[0] for c in want.description]
        clean = lambda rows: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=str)
        assert clean(map(tuple, mine.select(columns).collect())) == clean(want.fetchall()), name


def test_native_queries_run_no_python(spark):
    for name in ("op1_secret_scan", "op8_mix_sources", "op9_exact_dedup", "op10_url_filter"):
        plan = registry.queries()[name](spark, str(DATA))._jdf.queryExecution().toString()
        assert "Python" not in plan and "InArrow" not in plan, name


def test_pipeline_against_its_stages(spark):
    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    sizes = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = stage(spark, docs, str(DATA))
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        sizes[name] = docs.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before
    assert sizes["exact_dedup"] <= sizes["quality_classifier"] and sizes["simhash_dedup"] <= sizes["exact_dedup"]
    got = corpus_pipeline.run(spark, str(DATA))
    key = lambda rows: sorted(map(tuple, rows))
    assert key(got.collect()) == key(docs.collect())


def test_entry_without_these_folders(tmp_path):
    """The rest imports without this subpackage, and errors inside it are not swallowed."""
    root = Path(__file__).resolve().parents[2]
    ignore = lambda d, names: [n for n in names if n in ("llm", "corpus_pipeline.py", ".git", "__pycache__")]
    import shutil

    shutil.copytree(root, tmp_path / "repo", ignore=ignore)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); print(len(q))"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"}).returncode == 0
    shutil.copy(root / "corpus_pipeline.py", tmp_path / "repo")
    shutil.copytree(root / "veritome" / "llm", tmp_path / "repo" / "veritome" / "llm")
    (tmp_path / "repo" / "veritome" / "llm" / "bpe.py").write_text("import not_there")
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, env={"PATH": "/usr/bin:/bin"}).returncode != 0
