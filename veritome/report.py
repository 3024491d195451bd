"""The study's report: numbers of each check with a conclusion in words, tables, optional charts.

Everything here reads aggregates of a few rows; the data itself stays in Spark.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritome.operators.audit import Audit
from veritome.prompts import VARIANTS, feature_diff
from veritome.sources import sinks

SMALL_SUBSET, MAX_LISTED = 10, 25
FEATURE_NAMES = {"role": "papel", "delimiters": "delimitadores", "few_shot": "exemplos", "abstention": "abstenção", "chain_of_thought": "raciocínio"}


def percent(x: float | None, digits: int = 0) -> str:
    return "—" if x is None or x != x else f"{100 * x:.{digits}f}%".replace(".", ",")


def comma(x: float | None, digits: int = 2) -> str:
    return "—" if x is None or x != x else f"{x:.{digits}f}".replace(".", ",")


def share(x: float, n: int) -> str:
    return f"{round(x * n)}/{n}"


def short(doc: str) -> str:
    parts = doc.removesuffix(".pdf").split("_")
    return "_".join(parts[:3])


def listed(docs: Sequence[str]) -> str:
    more = len(docs) - MAX_LISTED
    return ", ".join(map(short, docs[:MAX_LISTED])) + (f" e mais {more}" if more > 0 else "")


def cell(value: Any) -> str:
    """A table cell in words: yes/no, decimal comma, thousands dot, a dash for nothing."""
    if value is None or value != value:
        return "—"
    if isinstance(value, bool):
        return "sim" if value else "não"
    if isinstance(value, int):
        return f"{value:,}".replace(",", ".")
    if isinstance(value, float):
        return comma(value)
    return "; ".join(map(str, value)) if isinstance(value, list | tuple) else str(value)


def ascii_token(text: str) -> str:
    return re.sub(r"[^A-Za-z0-9]", "", unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode())


def delivery_name(members: Sequence[str], prefix: str = "AtividadeI") -> str:
    """File name from members' last names; placeholders in << >> don't count."""
    names = [ascii_token(m.split()[-1]) for m in members if m.strip() and "<<" not in m]
    return "_".join([prefix, *filter(None, names)]) if names else f"{prefix}_SOBRENOMES"


def features_label(variant: str) -> str:
    return ", ".join(name for key, name in FEATURE_NAMES.items() if getattr(VARIANTS[variant], key))


def describe_diff(a: str, b: str) -> str:
    state = {True: "on", False: "off"}
    parts = [f"{k}: {state[x]} → {state[y]}" for k, (x, y) in feature_diff(a, b).items()]
    return f"{a} × {b}: " + ("; ".join(parts) or "mesmas técnicas")


_COPIED = re.compile(r"campo (\S+) copiado do exemplo few-shot \(similaridade ([\d.]+)\)")
_TERMS = re.compile(r"campo (\S+) contém (.+), termos? do exemplo few-shot ausentes? do texto enviado")


def compact_reasons(reasons: Sequence[str] | None) -> list[str]:
    """Reasons with all copied fields in one and all terms in one; the others as they are."""
    copied, terms, rest = {}, {}, []
    for r in reasons or ():
        if m := _COPIED.fullmatch(r):
            copied[m[1]] = float(m[2])
        elif m := _TERMS.fullmatch(r):
            terms[m[1]] = m[2].split(", ")
        else:
            rest.append(r)
    out = []
    if copied:
        low, high, s = min(copied.values()), max(copied.values()), "s" * (len(copied) > 1)
        out.append(f"campo{s} {', '.join(copied)} copiado{s} do exemplo few-shot (similaridade {low:.2f}" + (f"–{high:.2f})" if high > low else ")"))
    if terms:
        distinct = dict.fromkeys(t for ts in terms.values() for t in ts)
        out.append(f"termos do exemplo few-shot ausentes do texto enviado em {', '.join(terms)}: {', '.join(distinct)}")
    return out + rest


def not_defensible_table(audit: Audit) -> DataFrame:
    compact = F.udf(lambda r: "; ".join(compact_reasons(r)), T.StringType(), useArrow=True)
    return audit.tables()["not_defensible"].select("doc", compact("reasons").alias("reasons"))


@dataclass
class Section:
    """A check: its numbers, and what they say."""

    title: str
    numbers: dict[str, str]
    conclusion: str

    def text(self) -> str:
        return "; ".join(f"{k}: {v}" for k, v in self.numbers.items()) + f". {self.conclusion}"


def _docs(rows: DataFrame, cond: str) -> list[str]:
    """Names for a sentence: as many as it lists and one more to know that there are more."""
    return [r[0] for r in rows.filter(cond).select("doc").orderBy("doc").limit(10 * MAX_LISTED).collect()]


def _most_changed(fields: DataFrame, k: int = 3) -> str:
    rows = [r for r in fields.collect() if r.change_rate > 0][:k]  # at most a row per field
    return ", ".join(f"{r.field} {percent(r.change_rate)}" for r in rows) or "nenhum"


def fidelity_section(t: Mapping[str, DataFrame]) -> Section:
    s = t["fidelity_summary"].first()
    if s is None:
        return Section("Fidelidade", {}, "Nenhum registro a verificar.")
    numbers = {"trecho encontrado": f"{s.n_found}/{s.n} ({percent(s.rate_found)})", "página correta": f"{s.n_page_ok}/{s.n}", "exato / aproximado / sem ficha": f"{s.n_exact} / {s.n_fuzzy} / {s.n_none}"}
    parts = []
    for cond, words in (("not found and method <> 'none'", "trecho fora do texto enviado"), ("found and not page_ok", "trecho real em outra página"), ("method = 'none'", "sem ficha válida")):
        if docs := _docs(t["fidelity"], cond):
            parts.append(f"{words}: {listed(docs)}.")
    return Section("Fidelidade", numbers, " ".join(parts) or "Todos os trechos estão no texto enviado, na página declarada.")


def stability_section(t: Mapping[str, DataFrame]) -> Section:
    d = t["stability"].first()
    numbers = {"pares": str(d.n_pairs), "fichas idênticas": f"{d.n_identical}/{d.n_pairs} ({percent(d.rate_identical)})", "campos que mais mudam": _most_changed(t["stability_fields"])}
    changed = d.n_pairs - d.n_identical
    return Section("Estabilidade", numbers, f"{changed} ficha(s) mudaram sem que nada mudasse." if changed else "As duas execuções coincidem: a variação vem da entrada e da temperatura.")


def input_section(t: Mapping[str, DataFrame], names: tuple[str, str] = ("A", "B")) -> Section:
    d, m = t["input"].first(), {r.metric: r for r in t["input_metrics"].collect()}
    numbers = {
        "estratégias": " × ".join(names), "fichas idênticas": f"{d.n_identical}/{d.n_pairs}", "divergências de conteúdo": str(t["input_disagreements"].count()),
        "fidelidade": f"{percent(m['rate_fidelity'].a)} · {percent(m['rate_fidelity'].b)}", "campos que mais divergem": _most_changed(t["input_fields"]),
    }
    for metric, more, words in (("rate_fidelity", True, "fidelidade"), ("rate_page_ok", True, "página correta"), ("rate_parse_failed", False, "falhas de parse"), ("input_tokens", False, "tokens de entrada")):
        a, b = m[metric].a, m[metric].b
        if a is not None and b is not None and abs(a - b) > 1e-9:
            return Section("Efeito da entrada", numbers, f"Fica {names[0] if (a > b) == more else names[1]}, por {words} ({comma(a)} × {comma(b)}).")
    return Section("Efeito da entrada", numbers, f"Empate em todos os critérios; fica {names[0]}.")


def temperature_section(t: Mapping[str, DataFrame]) -> Section:
    r = t["temperature"].first()
    numbers = {"subconjunto": f"{r.n_alt or 0} documentos", "JSON de primeira": f"{percent(r.rate_first_try_t0)} · {percent(r.rate_first_try_alt)}", "fidelidade": f"{percent(r.rate_fidelity_t0)} · {percent(r.rate_fidelity_alt)}", "pares idênticos": percent(r.rate_identical)}
    said = "A temperatura escolhida se sustenta." if r.base_holds else "Pelo critério declarado, a temperatura escolhida perde neste subconjunto."
    return Section("Efeito da temperatura", numbers, said + (f" Com menos de {SMALL_SUBSET} documentos, é só um indício." if (r.n_alt or 0) < SMALL_SUBSET else ""))


def leakage_section(summaries: DataFrame) -> Section:
    rows = summaries.orderBy("run_id").collect()  # a row per run
    numbers = {r.run_id: f"{r.n_with_leak}/{r.n}" for r in rows}
    return Section("Vazamento de exemplos", numbers, "Há fichas que repetem os exemplos do prompt." if any(r.n_with_leak for r in rows) else "Nenhuma ficha repete os exemplos do prompt.")


def prompt_section(metrics: DataFrame, a: str, b: str) -> Section:
    m = {r.metric: r for r in metrics.collect()}
    numbers = {k: f"{percent(m[k].a)} · {percent(m[k].b)}" for k in m if k.startswith("rate_")}
    winner, why = a, "empate em todos os critérios"
    for k in ("rate_first_try", "rate_fidelity", "rate_null_when_expected"):
        if None not in (m[k].a, m[k].b) and abs(m[k].a - m[k].b) > 1e-9:
            winner, why = (a, k) if m[k].a > m[k].b else (b, k)
            break
    text = f"Fica {winner} ({why}). {describe_diff(a, b)}."
    leak = m["rate_fewshot_leak"]
    if leak.a != leak.b:
        text += f" Em troca, {a if leak.a > leak.b else b} copia mais dos exemplos ({percent(max(leak.a, leak.b))} × {percent(min(leak.a, leak.b))})."
    return Section("Comparação dos prompts", numbers, text)


def cost_section(comparison: DataFrame, premise: str) -> Section:
    c = comparison.first()
    numbers = {"US$ real": comma(c.real_usd, 4), "US$ ingênuo": comma(c.naive_usd, 4), "razão": f"{comma(c.ratio, 1)}×", "economia": percent(c.savings_share)}
    return Section("Custo", numbers, f"Enviar tudo usaria {comma(c.token_ratio, 1)}× os tokens de entrada. {premise}")


def coverage_sentence(recall: DataFrame, final_share: float | None = None) -> str:
    rows = recall.orderBy("strategy").collect()  # a row per strategy
    if not rows:
        return ""
    each = ", ".join(f"{r.strategy} {r.in_context} ({percent(r.recall)}; {r.docs_covered}/{r.docs_with_sentences} documentos)" for r in rows)
    late = f" {percent(final_share)} delas estão no terço final." if final_share is not None else ""
    return f"De {rows[0].sentences} frases de limitação declarada, chegaram ao contexto: {each}.{late}"


def budget_sentence(curve: DataFrame) -> str:
    return "Recall por orçamento: " + " · ".join(f"{r.strategy}: {percent(r.recall)}, ~{cell(r.tokens_per_doc)} tokens" for r in curve.orderBy("mean_chars").collect()) + "."


def before_after_sentence(outcome: DataFrame, key: str, before: str, after: str) -> str:
    rows = {r[key]: r for r in outcome.filter(F.col(key).isin(before, after)).collect()}
    if rows.keys() != {before, after}:
        return ""
    a, b = rows[before], rows[after]
    held = "" if b.limitation_null < a.limitation_null else f" {after} não reduziu os nulos."
    return f"limitacao nula: {a.limitation_null}/{a.n} com {before}, {b.limitation_null}/{b.n} com {after}; preenchida com trecho fiel: {a.filled_and_found} e {b.filled_and_found}.{held}"


def strategy_sentence(comparison: DataFrame, chosen: str, tried: str) -> str:
    rows = {r.strategy: r for r in comparison.filter(F.col("strategy").isin(chosen, tried)).collect()}
    if rows.keys() != {chosen, tried}:
        return ""
    a, b = rows[chosen], rows[tried]
    effect = "melhorou a saída" if b.legitimate > a.legitimate else "não mudou a saída"
    return f"{tried} {effect}: limitações legítimas {a.legitimate}/{a.n} e {b.legitimate}/{b.n}; {b.copied} copiada(s), {b.sentinel} sentinela(s); página correta {a.n_page_ok} e {b.n_page_ok}."


def calibration_sentence(t: Mapping[str, DataFrame], distributions: Mapping[str, Mapping[str, int]] | None = None) -> str:
    free = ("problem", "data", "method", "metric", "evidence.quote")
    mean = lambda df: df.filter(F.col("field").isin(*free)).agg(F.avg(F.nanvl("mean_similarity", F.lit(None)))).first()[0]
    parts = [f"{name}: " + "/".join(str(d.get(x, 0)) for x in ("alta", "media", "baixa")) for name, d in (distributions or {}).items()]
    if "input_fields" in t and "stability_fields" in t:
        parts.append(f"similaridade média dos textos: {comma(mean(t['input_fields']))} entre estratégias, {comma(mean(t['stability_fields']))} entre repetições")
    return "; ".join(parts) + "." if parts else ""


def highlight_sentence(cases: DataFrame, k: int = 2) -> str:
    """Up to ``k`` cases of invention in words."""
    kinds = ("campo copiado com trecho correto", "campo copiado e trecho fora do texto", "trecho fora do texto")
    rows = cases.limit(k).collect()
    return " ".join(f"{short(r.doc)} ({r.run_id}): {kinds[r.kind]}." for r in rows)


def bar_chart(rows: DataFrame, label: str, values: Sequence[str], path: str, title: str = "") -> Path | None:
    """A grouped bar chart as PNG, if matplotlib is there."""
    try:
        import matplotlib
    except ImportError:
        return None
    matplotlib.use("Agg")
    from matplotlib import pyplot as plt

    frame = rows.select(label, *values).limit(MAX_LISTED + 1).toPandas().set_index(label)
    if len(frame) > MAX_LISTED:
        raise ValueError(f"a chart shows {MAX_LISTED} rows at most; choose them first")
    axes = frame.plot.bar(title=title)
    axes.figure.tight_layout()
    axes.figure.savefig(path)
    plt.close(axes.figure)
    return Path(path)


@dataclass
class Report:
    """What a report holds, in order; prose given here stands before the measured sections."""

    title: str
    members: Sequence[str] = ()
    model: str = ""
    variants: tuple[str, str] = ("v_full", "v_sem_fewshot")
    prose: Mapping[str, str] = field(default_factory=dict)

    def write(self, path: str, audit: Audit, *, extra: Sequence[Section] = ()) -> Path:
        t = audit.tables()
        sections = [fidelity_section(t)]
        sections += [stability_section(t)] if "stability" in t else []
        sections += [input_section(t)] if "input" in t else []
        sections += [temperature_section(t)] if "temperature" in t else []
        sections += [prompt_section(t["prompts"], *self.variants)] if "prompts" in t else []
        body: dict[str, str | DataFrame] = {"Integrantes": ", ".join(self.members), "Modelo": self.model, **self.prose}
        body |= {s.title: s.text() for s in (*sections, *extra)}
        body |= {"Regra de confiança": audit.rule.describe(), "Distribuição": t["confidence"], "Fichas não defensáveis": not_defensible_table(audit)}
        return sinks.write_report({k: v for k, v in body.items() if not isinstance(v, str) or v}, path, self.title)
