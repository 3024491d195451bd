"""Token cost of recorded calls, and of sending whole documents instead."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritome.functions.text import approx_tokens

PER = 1_000_000


@dataclass(frozen=True)
class Price:
    """US dollars per million tokens, and where the figure is from."""

    input: float = 3.0
    output: float = 15.0
    source: str = "tabela pública"

    def describe(self) -> str:
        return f"Premissa: US$ {self.input:.2f} por 1M tokens de entrada e US$ {self.output:.2f} por 1M tokens de saída (fonte: {self.source})."


def priced(tokens: DataFrame, price: Price) -> DataFrame:
    """Rows of (n_calls, input_tokens, output_tokens, ...) with total tokens and dollars."""
    usd_in, usd_out = F.col("input_tokens") / F.lit(float(PER)) * price.input, F.col("output_tokens") / F.lit(float(PER)) * price.output
    return tokens.withColumns({"total_tokens": F.col("input_tokens") + F.col("output_tokens"), "usd_input": usd_in, "usd_output": usd_out, "usd_total": usd_in + usd_out, "premise": F.lit(price.describe())})


def cost(records: DataFrame, price: Price, *keys: str) -> DataFrame:
    """Cost of the calls that records stand for, per ``keys`` (``run_id`` for a table of runs)."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens")]
    return priced(records.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_calls"), *sums), price)


def naive_cost(documents: DataFrame, price: Price, *, calls: int = 1, output_tokens: int = 300, overhead: int = 0, count: Callable[[Column], Column] = approx_tokens) -> DataFrame:
    """Cost of ``calls`` prompts per document (doc, text) that hold all of it."""
    n = F.count(F.lit(1)) * calls
    tokens = documents.agg(n.alias("n_calls"), (F.coalesce(F.sum(count(F.col("text")) + overhead), F.lit(0)) * calls).alias("input_tokens"), (n * output_tokens).alias("output_tokens"))
    return priced(tokens, price)


def naive_cost_of_records(records: DataFrame, documents: DataFrame, price: Price, *keys: str, count: Callable[[Column], Column] = approx_tokens) -> DataFrame:
    """Cost of the same calls with the whole document in place of the context; a record without its document fails the query."""
    full = documents.select("doc", count(F.col("text")).alias("_full"))
    joined = records.join(full, "doc", "left")
    known = F.when(F.col("_full").isNull(), F.raise_error(F.concat(F.lit("no document for a record of "), F.coalesce(F.col("doc"), F.lit("null"))))).otherwise(F.col("_full"))
    swapped = F.greatest(F.lit(0), F.col("input_tokens") - count(F.col("context_text")) + known.cast("long"))
    return cost(joined.withColumn("input_tokens", swapped), price, *keys)


def compare(real: DataFrame, naive: DataFrame, *keys: str) -> DataFrame:
    """Ratios and savings of naive against real cost; different premises fail the query."""
    cols = ["input_tokens", "usd_total", "premise"]
    side = lambda df, p: df.select(*keys, *(F.col(c).alias(f"{p}_{c}") for c in cols))
    both = side(real, "real").join(side(naive, "naive"), list(keys)) if keys else side(real, "real").join(F.broadcast(side(naive, "naive")))
    checked = both.filter(F.when(F.col("real_premise") != F.col("naive_premise"), F.raise_error(F.lit("costs with different price premises can't be compared")).cast("boolean")).otherwise(True))
    over = lambda a, b: F.when(F.col(b) == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.col(a).cast("double"), F.col(b)))
    saved = F.col("naive_usd_total") - F.col("real_usd_total")
    return checked.select(
        *keys, F.col("real_usd_total").alias("real_usd"), F.col("naive_usd_total").alias("naive_usd"), over("naive_usd_total", "real_usd_total").alias("ratio"),
        over("naive_input_tokens", "real_input_tokens").alias("token_ratio"), saved.alias("savings_usd"), F.coalesce(F.try_divide(saved, F.col("naive_usd_total")), F.lit(0.0)).alias("savings_share"),
    )
