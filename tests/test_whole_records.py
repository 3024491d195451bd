"""Queries over records see whole texts: every document, every character, quotes from anywhere."""

from __future__ import annotations

import re

from veritome.operators import fidelity
from veritome.plans import catalog, views

LONG = " ".join(f"word{i}" for i in range(3000))
TEXTS = {1: "", 2: None, 3: "short text", 23: LONG, 34: LONG[::-1], 101: LONG, 17: "x" * 500 + " tail"}


def write(spark, folder):
    spark.createDataFrame([(i, t, "s", "en") for i, t in TEXTS.items()], "doc_id long, text string, source string, lang string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_contexts_hold_every_character(spark, tmp_path):
    sf = write(spark, tmp_path)
    for run in "ab":
        got = {r.doc_id: r for r in views.records(spark, sf, run).collect()}
        assert set(got) == set(TEXTS)
        for i, t in TEXTS.items():
            body = re.sub(r"(\n\n|^)\[p\. \d+\]\n", "", got[i].context_text)
            assert re.sub(r"\s", "", body) == re.sub(r"\s", "", t or "")
            assert len(re.sub(r"\s", "", body)) == len(re.sub(r"\s", "", t or ""))  # the share of characters seen is 1
            assert len(re.findall(r"^\[p\. \d+\]$", got[i].context_text, re.M)) == -(-len(t or "") // 400)


def test_quotes_come_from_beyond_two_pages(spark, tmp_path):
    sf = write(spark, tmp_path)
    found = {r.doc: r for r in fidelity.check_fidelity(views.records(spark, sf, "a")).collect()}
    assert found["d23"].page_ok and found["d101"].page_ok and found["d34"].page_ok
    assert max(found[d].page_found for d in ("d23", "d34", "d101")) > 2
    assert {r.doc for r in catalog.QUERIES["fidelity_scores"](spark, sf).collect()} == {f"d{i}" for i in TEXTS}


def test_gaps_are_a_few_ids(spark, tmp_path):
    sf = write(spark, tmp_path)
    for run in "ab":
        left_out = set(TEXTS) - {r.doc_id for r in views.records(spark, sf, run, gaps=True).collect()}
        assert left_out == set(views.GAPS[run]) & set(TEXTS)
