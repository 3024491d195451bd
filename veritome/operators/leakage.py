"""Leakage from few-shot examples: copied fields, and terms of an example that the text sent lacks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritome.functions.matching import blocks, match_form
from veritome.functions.similarity import may_reach, partial_ratio, ratio
from veritome.functions.text import rate
from veritome.prompts import EXAMPLES, Example
from veritome.schemas import FIELDS, TEXT_FIELDS

THRESHOLD, LEAST_PARTIAL = 0.80, 40


class Marker(NamedTuple):
    """A term of an example's domain: how a card words it, how a text would, and which example it marks."""

    in_card: str
    in_text: str
    example: str


# Terms of the default examples' domains.
MARKERS = (
    Marker(r"\bfraude", r"\bfraud", "com_limitacao"),
    Marker(r"\bchargebacks?\b", r"\bchargebacks?\b", "com_limitacao"),
    Marker(r"cart[aã]o de cr[eé]dito", r"credit.card", "com_limitacao"),
    Marker(r"\bemissor", r"\bissuer", "com_limitacao"),
    Marker(r"\btransa[cç](?:[aã]o|[oõ]es)\b", r"\btransactions?\b", "com_limitacao"),
    Marker(r"\bsupermercados?\b", r"\bsupermarkets?\b", "sem_limitacao"),
    Marker(r"\bvarej", r"\bretail", "sem_limitacao"),
    Marker(r"\bvendas\b", r"\bsales\b", "sem_limitacao"),
    Marker(r"\bestoques?\b", r"\binventor(?:y|ies)\b", "sem_limitacao"),
    Marker(r"\bpromo[cç](?:[aã]o|[oõ]es)\b", r"\bpromotions?\b", "sem_limitacao"),
    Marker(r"\bferiados?\b", r"\bholidays?\b", "sem_limitacao"),
    Marker(r"\bwmape\b", r"\bwmape\b", "sem_limitacao"),
    Marker(r"suaviza[cç][aã]o exponencial", r"exponential smoothing", "sem_limitacao"),
)


def text_values(records: DataFrame) -> DataFrame:
    """Long form (run_id, doc, field, value) of the cards' texts."""
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.col(FIELDS[f]).alias("value")) for f in TEXT_FIELDS))
    return records.filter("card is not null").select("run_id", "doc", F.inline(fields)).filter("value is not null")


@lru_cache(maxsize=256)
def _form(text: str) -> str:
    return match_form(text)


@lru_cache(maxsize=64)
def _sent(context: str) -> str:
    return " ".join(text for _, text in blocks(context))


def closest(field: str, value: str, examples: Sequence[Example], cutoff: float = 0.0) -> tuple[float, str, int, str] | None:
    """(similarity, method, example, its text): the example most like a field's value, None if none reaches ``cutoff``."""
    form, best = match_form(value), None

    def offer(score: float, method: str, i: int, text: str) -> None:
        nonlocal best
        if best is None or score > best[0]:
            best = (round(score, 4), method, i, text)

    for i, ex in enumerate(examples):
        # What can't beat the best so far needn't be computed to the end.
        least = max(cutoff, best[0]) if best else cutoff
        if (own := ex.fields.get(field)) is not None:
            other = _form(own)
            # Common characters can't outnumber the shorter text's.
            able = 2 * min(len(form), len(other)) >= least * (len(form) + len(other))
            whole = ratio(form, other) if able else 0.0
            part = partial_ratio(form, other, max(least, whole)) if min(len(form), len(other)) >= LEAST_PARTIAL else 0.0
            offer(max(part, whole), "partial_ratio" if part > whole else "ratio", i, own)
            least = max(cutoff, best[0])
        if field == "evidence.quote" and len(form) >= LEAST_PARTIAL:
            sent = _sent(ex.context)
            offer(partial_ratio(form, _form(sent), least), "partial_ratio_contexto", i, sent)
    return best if best and best[0] >= cutoff else None


def _able(fields: Sequence[str], values: Sequence[str], examples: Sequence[Example], cutoff: float) -> np.ndarray:
    """Which values may reach ``cutoff`` with an example: many at once, by bounds that lose none."""
    forms, out = [match_form(v) for v in values], np.zeros(len(values), bool)
    bar = cutoff - 5e-5  # similarities are rounded before they meet the cutoff
    for field in set(fields):
        rows = np.array([i for i, f in enumerate(fields) if f == field])
        texts = [(_form(own), True) for ex in examples if (own := ex.fields.get(field)) is not None]
        if field == "evidence.quote":
            texts += [(_form(_sent(ex.context)), False) for ex in examples]
        for text, whole in texts:
            rest = rows[~out[rows]]
            out[rest] = may_reach([forms[i] for i in rest], text, bar, whole=whole)
    return out


def copied_fields(records: DataFrame, examples: Sequence[Example] = EXAMPLES, cutoff: float = 0.0) -> DataFrame:
    """(run_id, doc, field, value, similarity, method, example_index, example_name, example_value): each field's closest example.

    Without ``cutoff`` every field has its row, to calibrate by; with one, only fields that
    reach it, and most comparisons end at a bound that is worked out for a batch at once.
    """
    names = [e.name for e in examples]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fields, values = b.column(2).to_pylist(), b.column(3).to_pylist()
            able = _able(fields, values, examples, cutoff) if cutoff else np.ones(len(values), bool)
            hits = [closest(f, v, examples, cutoff) if a else None for f, v, a in zip(fields, values, able, strict=True)]
            keep = pa.array([h is not None for h in hits], pa.bool_())
            hits = [h for h in hits if h]
            rows = b.filter(keep)
            made = [pa.array([h[0] for h in hits], pa.float64()), pa.array([h[1] for h in hits], pa.string()), pa.array([h[2] for h in hits], pa.int32()), pa.array([names[h[2]] for h in hits], pa.string()), pa.array([h[3] for h in hits], pa.string())]
            yield pa.RecordBatch.from_arrays([*rows.columns, *made], ["run_id", "doc", "field", "value", "similarity", "method", "example_index", "example_name", "example_value"])

    return text_values(records).mapInArrow(run, "run_id string, doc string, field string, value string, similarity double, method string, example_index int, example_name string, example_value string")


def term_leaks(records: DataFrame, markers: Sequence[Marker] = MARKERS, examples: Sequence[Example] = EXAMPLES) -> DataFrame:
    """The same columns for terms of an example in a field whose counterpart the text sent lacks, natively.

    The markers are a short list, so they are columns of the row: no join, no shuffle.  A text is
    searched only for markers that its card has.
    """
    names = [e.name for e in examples]
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.col(FIELDS[f]).alias("value")) for f in TEXT_FIELDS))
    of_card = records.filter("card is not null").select("run_id", "doc", fields.alias("_fields"), F.col("context_text").alias("_context"))
    said = lambda m: F.exists("_fields", lambda x: F.coalesce(x["value"].rlike(f"(?i){m.in_card}"), F.lit(False)))
    absent = of_card.select("run_id", "doc", "_fields", *(F.when(said(m), ~F.col("_context").rlike(f"(?i){m.in_text}")).otherwise(False) for m in markers))
    absent = absent.toDF("run_id", "doc", "_fields", *(f"_absent{i}" for i in range(len(markers))))
    long = absent.select("run_id", "doc", F.inline("_fields"), *absent.columns[3:]).filter("value is not null")
    hits = [
        F.when(F.col(f"_absent{i}") & F.col("value").rlike(f"(?i){m.in_card}"), F.struct(F.lit(names.index(m.example) if m.example in names else -1).alias("example_index"), F.lit(m.example).alias("example_name"), F.regexp_extract("value", f"(?i){m.in_card}", 0).alias("example_value")))
        for i, m in enumerate(markers)
    ]
    found = long.select("run_id", "doc", "field", "value", F.lit(1.0).alias("similarity"), F.lit("termo_do_exemplo").alias("method"), F.inline(F.array_compact(F.array(*hits))))
    return found


def copies(records: DataFrame, examples: Sequence[Example] = EXAMPLES, threshold: float = THRESHOLD) -> DataFrame:
    """Fields that are copies of an example's."""
    # Similarities are rounded before they meet the threshold, so the search stops a little below it.
    return copied_fields(records, examples, threshold - 5e-5).filter(F.col("similarity") >= threshold)


def leaks(records: DataFrame, examples: Sequence[Example] = EXAMPLES, markers: Sequence[Marker] = MARKERS, threshold: float = THRESHOLD) -> DataFrame:
    """All leaks of all records, copies and terms."""
    found = copies(records, examples, threshold)
    return found.unionByName(term_leaks(records, markers, examples)) if markers else found


def leaked_by_doc(found: DataFrame) -> DataFrame:
    """(run_id, doc, leaked): fields with a leak, in field order."""
    place = F.array_position(F.array(*map(F.lit, TEXT_FIELDS)), F.col("field"))
    fields = F.array_sort(F.collect_set(F.struct(place.alias("at"), "field")))
    return found.groupBy("run_id", "doc").agg(F.transform(fields, lambda s: s["field"]).alias("leaked"))


def leakage_summary(records: DataFrame, found: DataFrame) -> DataFrame:
    """Per run: records, records with a leak, rate, and records per leaked field, zeros included."""
    hit = found.groupBy("run_id", "doc").agg(*(F.max(F.when(F.col("field") == f, 1).otherwise(0)).alias(f"_{i}") for i, f in enumerate(TEXT_FIELDS)), F.lit(1).alias("_any"))
    both = records.select("run_id", "doc").join(hit, ["run_id", "doc"], "left")
    n = F.count(F.lit(1))
    return both.groupBy("run_id").agg(
        n.alias("n"), F.count("_any").alias("n_with_leak"), rate(F.count("_any"), n).alias("rate"), *(F.coalesce(F.sum(f"_{i}"), F.lit(0)).alias("n_" + f.replace(".", "_")) for i, f in enumerate(TEXT_FIELDS))
    )
