from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from veritome.functions.completion import CARD
from veritome.operators import confidence, cost, diff, fidelity, leakage, overview, stats
from veritome.prompts import EXAMPLES
from veritome.schemas import RECORDS

TEXT = "We study river floods. The gauge network covers the whole basin since 1950. Results are limited by sparse data."
CONTEXT = f"[p. 1]\n{TEXT}\n\n[p. 2]\nA second page says other things about birds and rain."
QUOTE = "The gauge network covers the whole basin"


def record(doc, *, run="a", quote=QUOTE, page=1, limitation="limited by sparse data", problem="floods", failed=False, context=CONTEXT, status=None, tokens=1000):
    card = None if failed else {"problem": problem, "data": "gauges", "method": "regression", "metric": "error", "limitation": limitation, "evidence": {"quote": quote, "page": page}}
    values = {
        "run_id": f"run_{run}", "doc": doc, "strategy": "first_pages", "prompt_variant": "v_full", "prompt_sha": "x", "model": "stub", "temperature": 0.0, "seed": 42, "repetition": 1, "seq": 1,
        "context_text": context, "context_pages": [1, 2], "raw_output": "{}", "input_tokens": tokens, "output_tokens": 100, "latency_s": 0.01, "first_try": not failed,
        "parse_status": status or ("failed" if failed else "ok"), "card": card, "error": None, "repairs": [], "doc_sha256": None, "created_at": None,
    }
    return tuple(values[f.name] for f in RECORDS)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), RECORDS)


def test_fidelity(spark):
    rows = frame(
        spark, record("exact"), record("other page", page=2), record("fuzzy", quote="The gauge netwrk covers the whole basins"), record("reworded", quote="Gauges exist all over that basin's area"),
        record("invented", quote="zzz qqq www xxx vvv kkk"), record("typography", quote="the  GAUGE network\ncovers the whole basin"), record("none", failed=True),
    )
    got = {r.doc: r for r in fidelity.check_fidelity(rows).collect()}
    assert (got["exact"].method, got["exact"].score, got["exact"].page_ok) == ("exact", 1.0, True)
    assert (got["other page"].found, got["other page"].page_found, got["other page"].page_ok) == (True, 1, False)
    assert got["fuzzy"].method == "fuzzy" and got["fuzzy"].score >= 0.9 and got["fuzzy"].page_ok
    assert not got["reworded"].found and got["invented"].score < 0.6
    assert got["typography"].method == "exact"
    assert (got["none"].method, got["none"].found, got["none"].score) == ("none", False, 0.0)
    s = fidelity.fidelity_summary(fidelity.check_fidelity(rows)).first()
    assert (s.n, s.n_found, s.n_exact, s.n_none) == (7, 4, 3, 1)


def test_limitation(spark):
    plain = "[p. 1]\nNothing of the kind is said here at all."
    rows = frame(spark, record("a"), record("b", context=plain), record("c", limitation=None), record("d", limitation=None, context=plain), record("e", failed=True))
    got = {r.doc: (r.verdict, r.supported) for r in fidelity.check_limitation(rows).collect()}
    assert got == {"a": ("preenchida_com_suporte", True), "b": ("preenchida_sem_suporte", False), "c": ("null_suspeito", True), "d": ("null_ok", True), "e": ("sem_ficha", None)}


def test_diff(spark):
    a = frame(spark, record("same"), record("null", limitation=None), record("word", problem="abcd"), record("x"), record("f", failed=True))
    b = frame(spark, record("same"), record("null"), record("word", problem="abce"), record("y"), record("f"))
    d = diff.field_diffs(a, b)
    got = {(r.doc, r.field): (r.equal, r.similarity) for r in d.collect()}
    assert got["same", "problem"] == (True, 1.0) and got["null", "limitation"] == (False, 0.0) and got["word", "problem"] == (False, 0.75)
    assert {r.doc: r.reason for r in diff.unpaired(a, b).collect()} == {"x": "ausente em B", "y": "ausente em A", "f": "extração falhou em A"}
    changes = {r.doc: r for r in diff.changes_by_doc(d).collect()}
    assert changes["word"].changed == ["problem"] and changes["null"].categorical == ["limitation"] and changes["same"].n_changed == 0
    assert tuple(diff.diff_summary(d).first()) == (3, 1, pytest.approx(1 / 3))
    assert diff.field_summary(d).first().field == "limitation"


def test_duplicates_fail(spark):
    with pytest.raises(PySparkException, match="more than one record"):
        diff.field_diffs(frame(spark, record("a"), record("a")), frame(spark, record("a"))).collect()


def test_leakage(spark):
    copied = EXAMPLES[1].fields["problem"]
    rows = frame(spark, record("copied", problem=copied), record("term", problem="Prever a fraude no rio"), record("clean"), record("failed", failed=True))
    found = leakage.leaks(rows)
    assert {(r.doc, r.field, r.method) for r in found.collect() if r.doc == "term"} == {("term", "problem", "termo_do_exemplo")}
    assert ("problem", "ratio", 1.0) in {(r.field, r.method, r.similarity) for r in found.collect() if r.doc == "copied"}
    s = leakage.leakage_summary(rows, found).first()
    assert (s.n, s.n_with_leak, s.n_problem, s.n_data) == (4, 2, 2, 0)


def test_markers_mark_their_examples():
    import re

    for m in leakage.MARKERS:
        example = next(e for e in EXAMPLES if e.name == m.example)
        assert re.search(m.in_card, " ".join(filter(None, example.fields.values())), re.I), m
        assert re.search(m.in_text, example.context, re.I), m


def test_run_stats_and_verdicts(spark):
    rows = frame(spark, record("a"), record("b", limitation=None), record("c", failed=True), record("d", status="repaired"))
    gold = spark.createDataFrame([("a", True), ("b", False), ("c", False)], "doc string, declares boolean")
    s = stats.run_stats(stats.audited(rows, gold=gold), "run_id").first()
    assert (s.n, s.rate_parse_ok, s.rate_parse_failed, s.rate_fidelity) == (4, 0.5, 0.25, 0.75)
    assert s.rate_limitation_null == pytest.approx(1 / 3) and (s.n_null_expected, s.rate_null_when_expected) == (1, 1.0)
    other = rows.withColumn("prompt_variant", F.lit("v_cot")).withColumn("first_try", F.lit(True)).withColumn("run_id", F.lit("run_b"))
    both = stats.audited(rows, gold=gold).unionByName(stats.audited(other, gold=gold))
    assert tuple(stats.compare_prompts(both, "v_full", "v_cot").first()) == ("v_cot", "rate_first_try")
    assert tuple(stats.compare_prompts(both, "v_full", "v_full").first()) == ("v_full", None)


def test_empty_run(spark):
    none = frame(spark)
    s = stats.run_stats(stats.audited(none)).first()
    assert (s.n, s.rate_fidelity, s.rate_null_when_expected, s.input_tokens) == (0, 0.0, None, 0)
    assert diff.diff_summary(diff.field_diffs(none, none)).first().rate_identical == 0.0


def test_confidence(spark):
    docs = ["good", "page", "invented", "failed", "null", "reviewed", "alone"]
    a = frame(spark, record("good"), record("page", page=2), record("invented", quote="zzz qqq www xxx vvv kkk"), record("failed", failed=True), record("null"), record("reviewed"), record("alone"))
    b = frame(spark, *(record(d, failed=d == "failed") for d in docs if d != "alone"))
    c = frame(spark, *(record(d, limitation=None if d == "null" else "limited by sparse data") for d in docs))
    rule = confidence.RULE_V2.with_review({"rev": "sigla sem apoio no texto"})
    out = confidence.assign(confidence.evidence(a, b, c, rule=rule), rule)
    got = {r.doc: (r.confidence, r.reasons) for r in out.collect()}
    assert {d: got[d][0] for d in docs} == {"good": "alta", "page": "baixa", "invented": "baixa", "failed": "baixa", "null": "media", "reviewed": "baixa", "alone": "media"}
    assert got["reviewed"][1] == ["revisão manual: sigla sem apoio no texto"] and got["page"][1][0].startswith("página errada: declarada p. 2")
    assert got["alone"][1] == ["comparação entre repetições não verificada"]
    table = {r.doc: r for r in confidence.final_table(out).collect()}
    assert len(table) == 7 and table["failed"].problem == confidence.FAILED_TEXT and table["failed"].page is None
    assert {r.confidence: r.n for r in confidence.distribution(out).collect()} == {"alta": 1, "media": 2, "baixa": 4}
    two = {r.doc: (r.v1, r.v2) for r in confidence.by_rule(a, b, c, {"v1": confidence.RULE_V1, "v2": confidence.RULE_V2}).collect()}
    assert two["good"] == ("alta", "alta") and two["reviewed"] == ("alta", "alta")


def test_cost(spark):
    price = cost.Price(3.0, 15.0)
    rows = frame(spark, record("a", tokens=1_000_000), record("b", run="b", tokens=0))
    got = {r.run_id: r for r in cost.cost(rows, price, "run_id").collect()}
    assert got["run_a"].usd_input == 3.0 and got["run_b"].usd_input == 0.0
    docs = spark.createDataFrame([("a", "x" * 400)], "doc string, text string")
    naive = cost.naive_cost(docs, price, calls=2, overhead=500).first()
    assert (naive.n_calls, naive.input_tokens, naive.output_tokens) == (2, 1200, 600)
    with pytest.raises(PySparkException, match="no document"):
        cost.naive_cost_of_records(rows, docs, price).collect()
    with pytest.raises(PySparkException, match="premises"):
        cost.compare(cost.cost(rows, price), cost.cost(rows, cost.Price(1.0, 1.0))).collect()
    free = cost.cost(rows, cost.Price(0.0, 0.0))
    assert cost.compare(free, free).first().ratio == float("inf")


def test_invention_cases(spark):
    rows = stats.audited(frame(spark, record("x", quote="zzz qqq www xxx vvv kkk"), record("y"), record("x", run="b", quote="zzz qqq www xxx vvv kkk"))).withColumn("leaked", F.expr("cast(null as array<string>)"))
    cases = overview.invention_cases(rows)
    assert [(r.run_id, r.doc, r.kind) for r in cases.collect()] == [("run_a", "x", 2)]
    assert [r.doc for r in overview.highlights(cases, 2).collect()] == ["x"]


def test_card_schema_is_shared():
    assert RECORDS["card"].dataType == CARD


def test_audit_tables_and_report(spark, tmp_path):
    from veritome import report
    from veritome.operators.audit import audit_runs

    runs = {
        "p": frame(spark, record("good"), record("page", page=2), record("failed", failed=True)),
        "r": frame(spark, record("good"), record("page"), record("failed")),
        "i": frame(spark, record("good", limitation=None), record("page"), record("failed")),
        "t": frame(spark, record("good")),
    }
    audit = audit_runs(runs.__getitem__, {"primary": "p", "repetition": "r", "other_input": "i", "other_temperature": "t", "other_prompt": "r"})
    tables = audit.tables()
    assert {"stability", "input_metrics", "temperature", "prompts", "cards"} <= tables.keys() and tables["cards"].count() == 3
    assert set(audit_runs(runs.__getitem__, {"primary": "p"}).tables()) == {"fidelity", "fidelity_summary", "leaks", "confidence", "cards", "not_defensible"}
    out = report.Report("Estudo", ["Ana Souza"], "stub").write(str(tmp_path / "r.html"), audit).read_text()
    assert all(w in out for w in ("Fidelidade", "Estabilidade", "Efeito da entrada", "Efeito da temperatura", "Comparação dos prompts", "Fichas não defensáveis"))
    with pytest.raises(ValueError, match="unknown roles"):
        audit_runs(runs.__getitem__, {"other": "p"})


def test_report_words():
    from veritome import report

    assert report.delivery_name(["Ana Souza", "João da Conceição"]) == "AtividadeI_Souza_Conceicao" and report.delivery_name(["<<x>>"]) == "AtividadeI_SOBRENOMES"
    assert report.describe_diff("v_full", "v_sem_fewshot") == "v_full × v_sem_fewshot: few_shot: on → off"
    many = [f"campo {f} copiado do exemplo few-shot (similaridade {s})" for f, s in (("problem", "0.80"), ("data", "0.95"))]
    terms = ["campo data contém 'fraude', 'vendas', termos do exemplo few-shot ausentes do texto enviado"]
    assert report.compact_reasons([*many, *terms, "outro"]) == [
        "campos problem, data copiados do exemplo few-shot (similaridade 0.80–0.95)",
        "termos do exemplo few-shot ausentes do texto enviado em data: 'fraude', 'vendas'",
        "outro",
    ]
    assert [report.cell(v) for v in (None, True, 1234, 0.5, ["a", "b"])] == ["—", "sim", "1.234", "0,50", "a; b"]
    assert (report.percent(0.955), report.percent(None), report.share(0.947, 19)) == ("96%", "—", "18/19")


def test_evidence_searches_once(spark, monkeypatch):
    """Copies are looked for once, a run compared with in both ways once, and rules that search alike share it all."""
    from veritome.plans import views

    a, b = (views.records(spark, "/root/testdata/sf0.001", run) for run in "ab")
    calls = []
    for module, name in ((confidence.leak, "copied_fields"), (confidence, "field_diffs"), (confidence, "check_fidelity")):
        plain = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *args, _f=plain, _n=name, **more: calls.append(_n) or _f(*args, **more))
    rules = {"v1": confidence.RULE_V1, "v2": confidence.RULE_V2}
    both = confidence.by_rule(a, b, b, rules, scores=False)
    assert sorted(calls) == ["check_fidelity", "copied_fields", "field_diffs"]
    assert str(both._jdf.queryExecution().optimizedPlan()).count("MapInArrow") == 2
    for name, rule in rules.items():
        alone = confidence.assign(confidence.evidence(a, b, b, rule=rule, scores=False), rule)
        assert {(r.doc, r[name]) for r in both.collect()} == {(r.doc, r.confidence) for r in alone.collect()}


def test_copies_are_searched_for_only_where_bounds_allow(monkeypatch):
    """Of values unlike any example none meets the search; copies, exact and near, all do."""
    names, examples = ("problem", "evidence.quote"), EXAMPLES
    own = [(f, v) for ex in examples for f in names if (v := ex.fields.get(f))]
    near = [(f, v.replace("a", "o", 2) + "!") for f, v in own]
    other = [(f, "zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich") for f in names]
    fields, values = zip(*own, *near, *other, strict=True)
    able = leakage._able(fields, values, examples, leakage.THRESHOLD)
    assert able.tolist() == [True] * len(own + near) + [False] * len(other)
    for f, v, a in zip(fields, values, able, strict=True):
        assert (leakage.closest(f, v, examples, leakage.THRESHOLD) is not None) <= a


def test_texts_are_searched_only_for_terms_of_their_card(spark):
    """A pattern that fails on the text isn't tried where the card lacks the term."""
    marker = leakage.Marker(r"\bzebra\b", r"(?:a|b)*c", "com_limitacao")
    rows = frame(spark, record("long", context="ab" * 50_000), record("short", context="no such letters", problem="a zebra"), record("has", context="abc", problem="a zebra"))
    assert [(r.doc, r.field) for r in leakage.term_leaks(rows, (marker,)).collect()] == []
    assert [(r.doc, r.field) for r in leakage.term_leaks(rows, (marker._replace(in_text="savanna"),)).orderBy("doc").collect()] == [("has", "problem"), ("short", "problem")]


def test_records_are_counted_where_they_are_joined(spark):
    """The check for a second record deals records out once."""
    rows = frame(spark, record("one"), record("two"))
    checked = diff.one_per_doc(rows, "A")
    assert checked._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(r.doc for r in checked.collect()) == ["one", "two"]
    with pytest.raises(PySparkException, match="run A has more than one record of two"):
        diff.one_per_doc(rows.union(rows.filter("doc = 'two'")), "A").collect()
