"""Overviews: corpus sizes with a total, what each strategy sends, recall of limitation sentences, tables for the report."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritome.functions.text import approx_tokens, normalize, rate, sentences
from veritome.operators.selection import Hybrid, Strategy, context_chars, context_pages, rendered, select_contexts, select_under

# Sentences that measure declared limitations; not the cues that select them.
LIMITATION_SENTENCE = (
    r"limitations? of (?:this|our|the present) (?:study|work|approach|method|analysis)|(?:is|are|remains?) limited (?:by|to)|we (?:acknowledge|note|caution|caveat)"
    r"|(?:a|one|another|the main) (?:limitation|caveat|drawback|shortcoming)|beyond the scope of (?:this|the present)|not (?:able|possible) to"
    r"|cannot (?:be|capture|account)|(?:has|have) (?:several |some |a few |important |certain )?limitations"
)
KEY_CHARS = 80
REPORT_SENTINELS = ("não informado", "nao informado", "não informada", "nao informada", "não declarado", "nao declarado", "não declarada", "nao declarada", "n/a", "null", "none", "")


def full_texts(pages: DataFrame) -> DataFrame:
    """(doc, text): pages in order, blank lines between."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"])
    return pages.groupBy("doc").agg(F.array_join(ordered, "\n\n").alias("text"))


def profiles(pages: DataFrame) -> DataFrame:
    """(doc, n_pages, n_chars, sha256)."""
    size = pages.groupBy("doc").agg(F.count(F.lit(1)).alias("n_pages"), F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("n_chars"))
    return size.join(full_texts(pages).select("doc", F.sha2("text", 256).alias("sha256")), "doc")


def corpus_frame(sizes: DataFrame, key: str = "doc") -> DataFrame:
    """Sums of (pages, chars, tokens) per ``key`` and a TOTAL row, in one pass over grouping sets."""
    sums = [F.sum(c).alias(c) for c in ("pages", "chars", "tokens")]
    out = sizes.rollup(key).agg(F.grouping(key).alias("is_total"), *sums)
    return out.withColumn(key, F.when(F.col("is_total") == 1, F.lit("TOTAL")).otherwise(F.col(key)))


def selection_frame(contexts: DataFrame, sizes: DataFrame) -> DataFrame:
    """What is sent per (strategy, doc): pages, chunks, characters, tokens and share of the document; the marks count, so a share can pass 1."""
    text = rendered(F.col("chunks"))
    out = contexts.select("strategy", "doc", F.array_join(context_pages(F.col("chunks")), ", ").alias("pages_sent"), F.size("chunks").alias("n_chunks"), F.char_length(text).alias("chars"), approx_tokens(text).alias("tokens"))
    share = rate(F.col("chars"), F.col("n_chars"))
    return out.join(sizes.select("doc", "n_chars"), "doc").withColumn("share", share).drop("n_chars")


def strategy_summary(selection: DataFrame) -> DataFrame:
    whole = lambda c: F.bround(F.avg(c), 0).cast("long")
    return selection.groupBy("strategy").agg(
        F.bround(F.avg("n_chunks"), 1).alias("mean_chunks"), whole("chars").alias("mean_chars"), whole("tokens").alias("mean_tokens"), F.sum("tokens").alias("corpus_tokens"), F.bround(F.avg("share"), 3).alias("mean_share")
    )


def limitation_sentences(pages: DataFrame, pattern: str = LIMITATION_SENTENCE) -> DataFrame:
    """(doc, page, sentence) of sentences that state a limitation."""
    return pages.select("doc", "page", F.explode(sentences(F.col("text"))).alias("sentence")).filter(F.col("sentence").rlike(f"(?i){pattern}"))


def limitation_recall(pages: DataFrame, contexts: DataFrame, pattern: str = LIMITATION_SENTENCE) -> DataFrame:
    """(strategy, doc, n_sentences, n_in_context, n_chars): a sentence is in a context if its first normalised characters are."""
    keys = limitation_sentences(pages, pattern).groupBy("doc").agg(F.collect_list(F.left(normalize(F.col("sentence")), F.lit(KEY_CHARS))).alias("_keys"))
    sent = normalize(F.array_join(F.transform("chunks", lambda c: c["text"]), " "))
    joined = contexts.select("strategy", "doc", sent.alias("_sent"), context_chars(F.col("chunks")).alias("n_chars")).join(keys, "doc", "left")
    hits = F.size(F.filter("_keys", lambda k: F.contains(F.col("_sent"), k)))
    zero = lambda c: F.greatest(c, F.lit(0))
    return joined.select("strategy", "doc", zero(F.coalesce(F.size("_keys"), F.lit(0))).alias("n_sentences"), zero(F.coalesce(hits, F.lit(0))).alias("n_in_context"), "n_chars")


def recall_table(recall: DataFrame) -> DataFrame:
    """Per strategy: documents with such sentences, those covered, sentences, those in context, their share, mean characters."""
    total, hit = F.sum("n_sentences"), F.sum("n_in_context")
    return recall.groupBy("strategy").agg(
        F.count_if(F.col("n_sentences") > 0).alias("docs_with_sentences"), F.count_if(F.col("n_in_context") > 0).alias("docs_covered"), total.alias("sentences"), hit.alias("in_context"),
        F.round(F.try_divide(hit.cast("double"), total), 3).alias("recall"), F.bround(F.avg("n_chars"), 0).cast("long").alias("mean_chars"),
    )


def recall_of(pages: DataFrame, strategies: Mapping[str, Strategy], pattern: str = LIMITATION_SENTENCE) -> DataFrame:
    out = None
    for name, how in strategies.items():
        one = select_contexts(pages, how).withColumn("strategy", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return recall_table(limitation_recall(pages, out, pattern))


def budget_curve(pages: DataFrame, base: Hybrid, budgets: tuple[int | None, ...], pattern: str = LIMITATION_SENTENCE) -> DataFrame:
    """Recall of the hybrid strategy under several budgets, with estimated tokens per document."""
    names = {f"hybrid {b // 1000}k" if b else "hybrid sem teto": b for b in budgets}
    table = recall_table(limitation_recall(pages, select_under(pages, base, names), pattern))
    limit = F.create_map(*(x for n, b in names.items() for x in (F.lit(n), F.lit(b).cast("int"))))
    return table.withColumns({"max_chars": limit[F.col("strategy")], "tokens_per_doc": F.bround(F.col("mean_chars") / 4.0, 0).cast("long")})


def final_pages_share(pages: DataFrame, last: float = 1 / 3, pattern: str = LIMITATION_SENTENCE) -> DataFrame:
    """(share): limitation sentences in the last part of their documents' pages; null without any."""
    n = pages.groupBy("doc").agg(F.count(F.lit(1)).alias("_n"))
    late = limitation_sentences(pages, pattern).join(n, "doc").select((F.col("page") > F.col("_n") * (1 - last)).alias("late"))
    return late.agg(F.try_divide(F.count_if("late").cast("double"), F.count(F.lit(1))).alias("share"))


def is_absent(c: Column) -> Column:
    return F.lower(F.btrim(F.trim(c), F.lit("."))).isin(*REPORT_SENTINELS)


def limitation_outcome(rows: DataFrame, *keys: str) -> DataFrame:
    """Per run: filled limitations, those with a verified quote, and the rest.  ``rows`` carry ``found``."""
    filled = F.col("card.limitation").isNotNull()
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(filled).alias("filled"), F.count_if(filled & F.col("found")).alias("filled_and_found"), (F.count(F.lit(1)) - F.count_if(filled)).alias("limitation_null")
    )


def strategy_comparison(rows: DataFrame, *keys: str) -> DataFrame:
    """Per run: cards, verified quotes and pages, leaks, and limitations that are legitimate, leaked or sentinels.

    ``rows`` carry found, page_ok and ``leaked`` (array of fields).
    """
    filled = F.col("card.limitation").isNotNull()
    absent = filled & F.coalesce(is_absent(F.col("card.limitation")), F.lit(False))
    copied = filled & F.coalesce(F.array_contains("leaked", "limitation"), F.lit(False))
    return rows.groupBy(*keys).agg(
        F.count_if(F.col("card").isNotNull()).alias("cards"), F.count(F.lit(1)).alias("n"), F.count_if("found").alias("n_found"), F.count_if("page_ok").alias("n_page_ok"), F.count_if(F.size("leaked") > 0).alias("n_leaked"),
        F.count_if(filled).alias("filled"), F.count_if(filled & ~absent & ~copied).alias("legitimate"), F.count_if(copied).alias("copied"), F.count_if(absent).alias("sentinel"), F.sum("input_tokens").alias("input_tokens"),
    )


def invention_cases(rows: DataFrame, run_order: str = "run_id") -> DataFrame:
    """First case per document over ordered runs: a leak or a quote that isn't in the text sent, with its kind.

    Kind 0: copied with a right quote; 1: copied with an unfound quote; 2: unfound quote only.
    """
    from veritome.operators.spans import best_k

    leaked = F.coalesce(F.size("leaked") > 0, F.lit(False))
    cases = rows.filter(F.col("card").isNotNull() & (leaked | ~F.col("found")))
    kind = F.when(leaked & F.col("found"), 0).when(leaked, 1).otherwise(2)
    return best_k(cases.withColumn("kind", kind), ["doc"], [F.col(run_order)], 1)


def highlights(cases: DataFrame, k: int = 2, prefer: tuple[str, ...] = ()) -> DataFrame:
    """Up to ``k`` cases: preferred prefixes, then one of each kind (1, 0, 2), then the rest by document."""
    from veritome.operators.spans import best_k

    place = F.lit(None).cast("int")
    for i, p in reversed(list(enumerate(prefer))):
        place = F.when(F.startswith("doc", F.lit(p)), i).otherwise(place)
    order = F.element_at(F.array(F.lit(1), F.lit(0), F.lit(2)), F.col("kind") + 1)
    first_of_kind = best_k(cases, ["kind"], [F.col("doc")], 1).select("doc", F.lit(True).alias("_first"))
    ranked = cases.join(F.broadcast(first_of_kind), "doc", "left").withColumn("_prefer", place)
    rank = F.coalesce("_prefer", F.when(F.col("_first"), F.lit(1000) + order).otherwise(F.lit(2000)))
    return ranked.orderBy(rank, "doc").limit(k).drop("_first", "_prefer")
