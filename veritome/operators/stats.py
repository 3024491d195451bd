"""Numbers of a run, and verdicts between two runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritome.functions.text import rate
from veritome.operators.diff import diff_summary, field_diffs, restrict_to
from veritome.operators.fidelity import check_fidelity, check_limitation
from veritome.operators.leakage import leaks
from veritome.schemas import STATUSES, TEXTS

METRICS = (
    "n", "rate_first_try", "rate_parse_ok", "rate_parse_repaired", "rate_parse_failed", "rate_limitation_null", "rate_null_when_expected",
    "n_null_expected", "rate_fidelity", "rate_page_ok", "rate_fewshot_leak", "input_tokens", "output_tokens",
)
EPSILON = 1e-9
#: Criteria in order: name, metric, and whether more is better.
PROMPT_CRITERIA = (("rate_first_try", True), ("rate_fidelity", True), ("rate_null_when_expected", True))
INPUT_CRITERIA = (("rate_fidelity", True), ("rate_page_ok", True), ("rate_parse_failed", False), ("input_tokens", False))


def run_summary(records: DataFrame, *keys: str) -> DataFrame:
    """Counts by status, zeros included, first-try rate (null without records), null limitations, tokens, latency."""
    n = F.count(F.lit(1))
    card = F.col("card").isNotNull()
    return records.groupBy(*keys).agg(
        n.alias("n"),
        *(F.count_if(F.col("parse_status") == s).alias(f"n_{s}") for s in STATUSES),
        F.count_if("first_try").alias("n_first_try"),
        F.round(F.try_divide(F.count_if("first_try").cast("double"), n), 4).alias("rate_first_try"),
        F.count_if(card & F.col("card.limitation").isNull()).alias("n_limitation_null"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.round(F.coalesce(F.sum("latency_s"), F.lit(0.0)), 3).alias("latency_s"),
    )


def repair_counts(records: DataFrame, *keys: str) -> DataFrame:
    """(keys, repair, n), most frequent first."""
    return records.select(*keys, F.explode("repairs").alias("repair")).groupBy(*keys, "repair").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "repair")


def audited(records: DataFrame, *, gold: DataFrame | None = None, fidelity: DataFrame | None = None, leaked: DataFrame | None = None) -> DataFrame:
    """Records, without their texts, with found, page_ok, leak and expects_null beside them; one row per record.

    ``gold`` (doc, declares) says whether authors declare a limitation; without it the
    limitation vocabulary of the text sent decides.
    """
    keys = ["run_id", "doc"]
    checked = (fidelity if fidelity is not None else check_fidelity(records, scores=False)).select(*keys, "found", "page_ok")
    hit = (leaked if leaked is not None else leaks(records)).select(*keys).distinct().withColumn("leak", F.lit(True))
    out = records.drop(*TEXTS).join(checked, keys, "left").join(hit, keys, "left")
    if gold is None:
        words = check_limitation(records).select(*keys, (F.size("words") == 0).alias("expects_null"))
        return out.join(words, keys, "left")
    return out.join(gold.select("doc", (~F.col("declares")).alias("expects_null")), "doc", "left")


def run_stats(rows: DataFrame, *keys: str) -> DataFrame:
    """The metrics of ``audited`` rows, each over its own declared denominator."""
    n, card, null = F.count(F.lit(1)), F.col("card").isNotNull(), F.col("card.limitation").isNull()
    expected = card & F.coalesce("expects_null", F.lit(False))
    status = lambda s: rate(F.count_if(F.col("parse_status") == s), n)
    return rows.groupBy(*keys).agg(
        n.alias("n"),
        rate(F.count_if("first_try"), n).alias("rate_first_try"),
        *(status(s).alias(f"rate_parse_{s}") for s in STATUSES),
        rate(F.count_if(card & null), F.count_if(card)).alias("rate_limitation_null"),
        F.try_divide(F.count_if(expected & null).cast("double"), F.count_if(expected)).alias("rate_null_when_expected"),
        F.count_if(expected).alias("n_null_expected"),
        rate(F.count_if("found"), n).alias("rate_fidelity"),
        rate(F.count_if("page_ok"), n).alias("rate_page_ok"),
        rate(F.count_if("leak"), n).alias("rate_fewshot_leak"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
    )


def side_by_side(stats: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(metric, a, b, delta): a row per metric from two rows of ``run_stats``."""
    long = stats.filter(F.col(key).isin(a, b)).select(key, F.posexplode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in METRICS))).alias("ord", "x"))
    pick = lambda side: F.max(F.when(F.col(key) == side, F.col("x.v")))
    out = long.groupBy("ord", F.col("x.metric").alias("metric")).agg(pick(a).alias("a"), pick(b).alias("b"))
    return out.select("ord", "metric", "a", "b", (F.col("b") - F.col("a")).alias("delta"))


def verdict(stats: DataFrame, key: str, a: str, b: str, criteria: Sequence[tuple[str, bool]]) -> DataFrame:
    """(winner, decided_by): the first criterion that differs decides; one that is null on a side is passed over; a tie leaves ``a``."""
    sides = stats.filter(F.col(key).isin(a, b)).agg(*(F.max(F.when(F.col(key) == s, F.struct(*METRICS))).alias(s_) for s, s_ in ((a, "_a"), (b, "_b"))))
    winner: Column = F.when(F.lit(False), F.struct(F.lit(a).alias("winner"), F.lit("").alias("decided_by")))
    for metric, more in criteria:
        x, y = F.col(f"_a.{metric}"), F.col(f"_b.{metric}")
        wins_a = x > y if more else x < y
        winner = winner.when(F.abs(x - y) > EPSILON, F.struct(F.when(wins_a, a).otherwise(b).alias("winner"), F.lit(metric).alias("decided_by")))
    tie = F.struct(F.lit(a).alias("winner"), F.lit(None).cast("string").alias("decided_by"))
    return sides.select(F.inline(F.array(winner.otherwise(tie))))


def compare_prompts(rows: DataFrame, a: str, b: str) -> DataFrame:
    return verdict(run_stats(rows, "prompt_variant"), "prompt_variant", a, b, PROMPT_CRITERIA)


def compare_inputs(rows: DataFrame, a: str, b: str) -> DataFrame:
    return verdict(run_stats(rows, "strategy"), "strategy", a, b, INPUT_CRITERIA)


def compare_temperatures(base: DataFrame, other: DataFrame) -> DataFrame:
    """One row: first-try and fidelity rates of both runs over the documents of ``other``, identical pairs, and whether the base holds."""
    same = restrict_to(base, other)
    stats = run_stats(audited(same.withColumn("_side", F.lit("t0"))), "_side").unionByName(run_stats(audited(other.withColumn("_side", F.lit("alt"))), "_side"))
    pick = lambda side, m: F.max(F.when(F.col("_side") == side, F.col(m))).alias(f"{m}_{side}")
    wide = stats.agg(*(pick(s, m) for m in ("n", "rate_first_try", "rate_fidelity") for s in ("t0", "alt")))
    holds = (F.col("rate_fidelity_t0") >= F.col("rate_fidelity_alt")) & (F.col("rate_first_try_t0") >= F.col("rate_first_try_alt"))
    identical = diff_summary(field_diffs(same, other)).select("rate_identical")
    return wide.withColumn("base_holds", holds).join(F.broadcast(identical))


def label_of(records: DataFrame, attr: str, default: str) -> DataFrame:
    """(label): the one value of a setting, or ``default`` if there are none or several."""
    values = F.collect_set(F.col(attr).cast("string"))
    return records.agg(F.when(F.size(values) == 1, F.element_at(values, 1)).otherwise(default).alias("label"))
