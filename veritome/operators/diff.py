"""Field by field comparison of two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veritome.functions.matching import match_form_of
from veritome.functions.similarity import similarity
from veritome.functions.text import rate
from veritome.schemas import FIELDS

CATEGORICAL = ("limitation",)


def field_order() -> Column:
    return F.array_position(F.array(*map(F.lit, FIELDS)), F.col("field"))


def one_per_doc(run: DataFrame, side: str) -> DataFrame:
    """``run`` with a check: a second record of a document fails the query, loudly and by name.

    Records are dealt out by document once, as the joins that follow need them, and counted there.
    """
    n = F.count(F.lit(1)).over(W.partitionBy("doc"))
    message = F.concat(F.lit(f"run {side} has more than one record of "), F.col("doc"))
    checked = run.filter("doc is not null").withColumn("_n", n)
    return checked.filter(F.when(F.col("_n") > 1, F.raise_error(message)).otherwise(F.lit(1)) == 1).drop("_n")


def paired(run_a: DataFrame, run_b: DataFrame) -> DataFrame:
    """(doc, has_a, has_b, a, b): full outer join of two runs' cards."""
    a = one_per_doc(run_a, "A").select("doc", F.lit(True).alias("has_a"), F.col("card").alias("a"))
    b = one_per_doc(run_b, "B").select("doc", F.lit(True).alias("has_b"), F.col("card").alias("b"))
    out = a.join(b, "doc", "full_outer")
    return out.withColumns({"has_a": F.coalesce("has_a", F.lit(False)), "has_b": F.coalesce("has_b", F.lit(False))})


def unpaired(run_a: DataFrame, run_b: DataFrame) -> DataFrame:
    """(doc, reason) of documents that can't be compared."""
    failed = F.concat(F.lit("extração falhou em "), F.array_join(F.array_compact(F.array(F.when(F.col("a").isNull(), "A"), F.when(F.col("b").isNull(), "B"))), " e "))
    reason = F.when(~F.col("has_a"), "ausente em A").when(~F.col("has_b"), "ausente em B").when(F.col("a").isNull() | F.col("b").isNull(), failed)
    return paired(run_a, run_b).select("doc", reason.alias("reason")).filter("reason is not null")


def field_diffs(run_a: DataFrame, run_b: DataFrame) -> DataFrame:
    """Long form (doc, field, a, b, equal, similarity) of documents with a card on both sides."""
    pairs = paired(run_a, run_b).filter("a is not null and b is not null")
    value = lambda side, path: F.col(path.replace("card", side, 1)).cast("string")
    fields = F.array(*(F.struct(F.lit(f).alias("field"), value("a", p).alias("a"), value("b", p).alias("b")) for f, p in FIELDS.items()))
    long = pairs.select("doc", F.inline(fields))
    # Equal raw text needs no normal form: Python sees only what differs.
    differs = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")) & (F.col("field") != "evidence.page")
    formed = long.withColumns({"_a": F.when(differs, match_form_of(F.col("a"))), "_b": F.when(differs, match_form_of(F.col("b")))})
    equal = F.when(differs, F.col("_a") == F.col("_b")).otherwise(F.col("a").eqNullSafe(F.col("b")))
    alike = F.when(equal, 1.0).when(differs, F.round(similarity(F.col("_a"), F.col("_b")), 4)).otherwise(0.0)
    return formed.select("doc", "field", "a", "b", equal.alias("equal"), alike.alias("similarity"))


def categorical() -> Column:
    """One side null, the other not, in a field where that is a statement."""
    return F.col("field").isin(*CATEGORICAL) & (F.col("a").isNull() != F.col("b").isNull())


def changes_by_doc(diffs: DataFrame) -> DataFrame:
    """(doc, n_changed, changed, n_categorical, categorical): counts and field names in field order."""
    names = lambda cond: F.transform(F.array_sort(F.array_compact(F.collect_list(F.when(cond, F.struct(field_order(), F.col("field").alias("f")))))), lambda s: s["f"])
    changed = ~F.col("equal")
    return diffs.groupBy("doc").agg(
        F.count_if(changed).alias("n_changed"), names(changed).alias("changed"), F.count_if(categorical()).alias("n_categorical"), names(categorical()).alias("categorical")
    )


def diff_summary(diffs: DataFrame) -> DataFrame:
    """One row: pairs, identical pairs and their rate."""
    docs = diffs.groupBy("doc").agg(F.every("equal").alias("same"))
    n = F.count(F.lit(1))
    return docs.agg(n.alias("n_pairs"), F.count_if("same").alias("n_identical"), rate(F.count_if("same"), n).alias("rate_identical"))


def field_summary(diffs: DataFrame) -> DataFrame:
    """(field, change_rate, mean_similarity), most unstable first: by change, then similarity, then field order."""
    n = F.count(F.lit(1))
    out = diffs.groupBy("field").agg(rate(F.count_if(~F.col("equal")), n).alias("change_rate"), F.avg("similarity").alias("mean_similarity"))
    return out.orderBy(F.col("change_rate").desc(), "mean_similarity", field_order())


def disagreements(diffs: DataFrame, below: float = 1.0) -> DataFrame:
    return diffs.filter(~F.col("equal") & (F.col("similarity") < below))


def config_warnings(run_a: DataFrame, run_b: DataFrame, attrs: tuple[str, ...] = ("strategy", "prompt_variant", "model", "temperature")) -> DataFrame:
    """(attr, values_a, values_b) of settings whose sets of values differ between two runs."""
    sets = lambda run: [F.array_sort(F.collect_set(F.col(a).cast("string"))).alias(a) for a in attrs]
    long = lambda run, out: run.agg(*sets(run)).select(F.explode(F.create_map(*(x for a in attrs for x in (F.lit(a), F.col(a))))).alias("attr", out))
    both = long(run_a, "values_a").join(long(run_b, "values_b"), "attr")
    return both.filter("values_a <> values_b")


def restrict_to(run: DataFrame, docs: DataFrame) -> DataFrame:
    return run.join(docs.select("doc").distinct(), "doc", "left_semi")
