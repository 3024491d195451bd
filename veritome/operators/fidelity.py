"""Quote verification: is a card's quote in the text that was sent, and on the page it names?"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veritome.functions.matching import block_array, blocks, match_form, match_form_of
from veritome.functions.similarity import best_window, partial_ratio
from veritome.functions.text import rate

THRESHOLD = 0.90
METHODS = ("exact", "fuzzy", "none")

# Fixed value: vocabulary with which authors state limitations.
LIMITATION_WORDS = (
    r"\b(?=[lsdctfw])(?:limitations?|limited|shortcomings?|drawbacks?|caveats?|threats? to (?:the )?validity"
    r"|future (?:work|research)|we acknowledge|weakness(?:es)?)\b"
)


def locate(quote: str, context: str, claimed: int | None, threshold: float, scores: bool = True) -> tuple[float | None, str, int | None]:
    """(score, method, page) of a quote in a rendered context.

    A page that holds the quote well enough is right even if another holds it first.  Without
    ``scores`` only windows that may reach the threshold are compared, and a lower score is None.
    """
    needle, parts = match_form(quote), [(page, match_form(text)) for page, text in blocks(context)]
    joined = " ".join(text for _, text in parts)

    def page_at(offset: int) -> int | None:
        end = -1
        for page, text in parts:
            end += len(text) + 1
            if offset <= end:
                return page or None
        return None

    at = joined.find(needle) if needle else -1
    if at >= 0:
        score, method, page = 1.0, "exact", page_at(at)
    elif not joined:
        score, method, page = 0.0, "fuzzy", None
    elif len(needle) <= len(joined):
        score, start, _ = best_window(needle, joined, 0.0 if scores else threshold)
        method, page = "fuzzy", page_at(start)
    else:
        score, method, page = partial_ratio(needle, joined, 0.0 if scores else threshold), "fuzzy", None
    if score < threshold:
        return score if scores else None, method, None
    on_claimed = any(needle in text or partial_ratio(needle, text, threshold) >= threshold for p, text in parts if p == claimed)
    return score, method, claimed if on_claimed else page


def check_fidelity(records: DataFrame, threshold: float = THRESHOLD, *, scores: bool = True) -> DataFrame:
    """(run_id, doc, found, score, method, page_claimed, page_found, page_ok) of every record.

    Records without a card have method ``none``.  Quotes that a plain substring test finds in a
    block of the claimed page are settled natively, and the contexts of only the others go to the fuzzy
    search.  Without ``scores`` those below the threshold are null, which spares the search through
    all windows of a text that doesn't hold its quote.
    """
    quote, claimed = F.col("card.evidence.quote"), F.col("card.evidence.page")
    base = records.select("run_id", "doc", quote.alias("_quote"), claimed.cast("int").alias("page_claimed"), F.col("context_text").alias("_context"))
    on_page = F.exists(block_array(F.col("_context")), lambda b: (b["page"] == F.col("page_claimed")) & F.contains(b["text"], F.trim("_quote")))
    open_ = F.col("_quote").isNotNull() & ((F.trim("_quote") == "") | ~F.coalesce(on_page, F.lit(False)))
    # The context is read and split once; one condition tells what of it is sent on.
    sent = F.when(open_, F.struct(F.col("_quote").alias("quote"), F.coalesce("_context", F.lit("")).alias("context")))
    rows = base.select("run_id", "doc", "page_claimed", F.col("_quote").isNull().alias("_none"), sent.alias("_sent"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [
                locate(x["quote"], x["context"], page, threshold, scores) if x else (0.0, "none", None) if none else (1.0, "exact", page)
                for page, none, x in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True)
            ]
            made = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.float64(), pa.string(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *made], ["run_id", "doc", "page_claimed", "score", "method", "page_found"])

    searched = rows.mapInArrow(run, "run_id string, doc string, page_claimed int, score double, method string, page_found int")
    found = (F.col("method") != "none") & F.coalesce(F.col("score") >= threshold, F.lit(False))
    return searched.select(
        "run_id", "doc", found.alias("found"), F.round("score", 4).alias("score"), "method", "page_claimed", "page_found",
        (found & F.coalesce(F.col("page_found") == F.col("page_claimed"), F.lit(False))).alias("page_ok"),
    )


def fidelity_summary(checked: DataFrame, *keys: str) -> DataFrame:
    """Counts and rates per ``keys``; failed records stay in the denominator."""
    n = F.count(F.lit(1))
    return checked.groupBy(*keys).agg(
        n.alias("n"), F.count_if("found").alias("n_found"), rate(F.count_if("found"), n).alias("rate_found"),
        F.count_if("page_ok").alias("n_page_ok"), rate(F.count_if("page_ok"), n).alias("rate_page_ok"),
        *(F.count_if(F.col("method") == m).alias(f"n_{m}") for m in METHODS),
    )


def page_of_offset(contexts: DataFrame, offsets: DataFrame) -> DataFrame:
    """Range join of offsets into the joined normal form with the blocks they fall in, ends included, first match."""
    rows = contexts.select("doc", F.posexplode(block_array(F.col("context_text"))).alias("ord", "b")).select("doc", "ord", F.col("b.page").alias("page"), match_form_of(F.col("b.text")).alias("t"))
    before = F.coalesce(F.sum(F.char_length("t") + 1).over(W.partitionBy("doc").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = rows.select(F.col("doc").alias("_doc"), "ord", "page", before.alias("start"), (before + F.char_length("t")).alias("end"))
    hit = offsets.join(placed, (F.col("doc") == F.col("_doc")) & F.col("offset").between(F.col("start"), F.col("end")), "left")
    return hit.groupBy("doc", "offset").agg(F.nullif(F.min_by("page", "ord"), F.lit(0)).alias("page"))


def limitation_words(context: Column, words: str = LIMITATION_WORDS) -> Column:
    """Sorted distinct limitation words of a context, lower case."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(context, F.lit(f"(?i){words}"), F.lit(0)), F.lower)))


def check_limitation(records: DataFrame, words: str = LIMITATION_WORDS) -> DataFrame:
    """(run_id, doc, limitation_is_null, words, verdict, supported): is a stated limitation backed by the text sent?"""
    base = records.select("run_id", "doc", F.col("card").isNotNull().alias("_card"), F.col("card.limitation").isNull().alias("_null"), limitation_words(F.col("context_text"), words).alias("words"))
    has = F.size("words") > 0
    verdict = (
        F.when(~F.col("_card"), "sem_ficha")
        .when(F.col("_null"), F.when(has, "null_suspeito").otherwise("null_ok"))
        .otherwise(F.when(has, "preenchida_com_suporte").otherwise("preenchida_sem_suporte"))
    )
    out = base.select("run_id", "doc", F.when(F.col("_card"), F.col("_null")).alias("limitation_is_null"), "words", verdict.alias("verdict"))
    return out.withColumn("supported", F.when(F.col("verdict") == "sem_ficha", F.lit(None)).otherwise(F.col("verdict") != "preenchida_sem_suporte"))
