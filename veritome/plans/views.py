"""Inputs of the queries, from the standard tables: pages, and records of two runs with planned faults.

The same rows are written once as DataFrames and once as SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritome.shipping import spread

NOWHERE = "this quotation does not occur in any of the texts"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *, heavy: bool = False) -> DataFrame:
    """(all columns, doc); ``heavy`` work on the texts is dealt out to all cores."""
    d = table(spark, sf_dir, "documents")
    return (spread(d) if heavy else d).withColumn("doc", F.concat(F.lit("d"), F.col("doc_id").cast("string")))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, page, text): the lines of a document as its pages."""
    lines = documents(spark, sf_dir, heavy=True).select("doc", F.posexplode(F.split("text", "\n", -1)).alias("at", "text"))
    return lines.select("doc", (F.col("at") + 1).alias("page"), "text")


def source_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, page, text): the documents of a source as the pages of one document."""
    return documents(spark, sf_dir, heavy=True).select(F.col("source").alias("doc"), F.col("doc_id").cast("int").alias("page"), "text")


def _strip(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


#: Pages of a context have so many characters, and a card's passage lies inside one of them.
PAGE_CHARS, PASSAGE = 400, 120
#: Documents that ``run`` leaves out where ``gaps`` are asked for.
GAPS = {"a": (3, 5), "b": (2, 7, 8)}


def records(spark: SparkSession, sf_dir: str, run: str, *, gaps: bool = False) -> DataFrame:
    """Records of run ``a`` or ``b`` over every document: whole texts as pages, cards from anywhere in them.

    Faults are planned by id: answers that failed, quotes that occur nowhere, pages that were
    not sent, fields that differ between the runs.  A text too short for a quote has one that
    occurs nowhere.
    """
    a, i = run == "a", F.col("doc_id")
    d = documents(spark, sf_dir, heavy=True)
    if gaps:
        d = d.filter(~i.isin(*GAPS[run]))
    d = d.withColumn("text", F.coalesce("text", F.lit("")))
    n_pages = F.ceil(F.char_length("text") / PAGE_CHARS).cast("int")
    at = F.pmod(i * 7919, F.greatest(n_pages, F.lit(1))).cast("int")
    # Plain substrings: cards are taken apart column by column, and each column works its passage out anew.
    own = F.substring("text", at * PAGE_CHARS + 1, F.lit(PAGE_CHARS))
    start = F.pmod(i * 31, F.greatest(F.char_length(own) - (PASSAGE - 1), F.lit(1))).cast("int")
    d = d.withColumns({"n_pages": n_pages, "at": at, "passage": F.substring(own, start + 1, F.lit(PASSAGE))})
    raw = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PAGE_CHARS}}}"), F.lit(0))
    context = F.array_join(F.transform(raw, lambda p, k: F.concat(F.lit("[p. "), (k + 1).cast("string"), F.lit("]\n"), _strip(p))), "\n\n")
    part = lambda start, n: F.substring("passage", start, n)
    failed = i % (11 if a else 19) == 0
    status = F.when(failed, "failed").when(i % 9 == 0, "repaired").otherwise("ok")
    card = F.struct(
        part(1, 40).alias("problem"),
        (part(41, 30) if a else F.when(i % 3 == 0, part(43, 30)).otherwise(part(41, 30))).alias("data"),
        part(71, 30).alias("method"),
        part(1, 20).alias("metric"),
        F.when(i % (5 if a else 10) != 0, F.concat(F.lit("limited by "), part(5, 20))).alias("limitation"),
        F.struct(
            F.when((i % 7 == 0) | (F.char_length("passage") <= 40), NOWHERE).otherwise(_strip(part(21, 60))).alias("quote"),
            F.when(i % 13 == 0, F.col("n_pages") + 1).otherwise(F.col("at") + 1).cast("long").alias("page"),
        ).alias("evidence"),
    )
    return _as_records(d.select("doc_id", "doc", "source", context.alias("context_text"), status.alias("parse_status"), F.when(~failed, card).alias("card")), run)


def _as_records(out: DataFrame, run: str) -> DataFrame:
    a, i = run == "a", F.col("doc_id")
    failed = F.col("parse_status") == "failed"
    return out.select(
        F.lit(f"run_{run}").alias("run_id"), "doc", F.lit("first_pages" if a else "semantic").alias("strategy"), F.lit("v_full" if a else "v_sem_fewshot").alias("prompt_variant"),
        F.lit("stub").alias("model"), F.lit(0.0 if a else 0.7).alias("temperature"), F.lit(1).alias("repetition"), F.col("doc_id").alias("seq"), "context_text", "parse_status", "card",
        (~failed & (i % 6 != 0)).alias("first_try"), F.when(F.col("parse_status") == "repaired", F.array(F.lit("virgula_final"))).otherwise(F.expr("cast(array() as array<string>)")).alias("repairs"),
        (F.char_length("context_text") + 500).cast("long").alias("input_tokens"), (i % 50 + 100).cast("long").alias("output_tokens"), ((i % 10) / 10.0).alias("latency_s"), "doc_id", "source",
    )


PAGES_SQL = "pages_v AS (SELECT 'd' || doc_id AS doc, generate_subscripts(l, 1)::INT AS page, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


def records_sql(run: str, *, gaps: bool = False) -> str:
    a = run == "a"
    strip = lambda x: rf"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"
    data = "substr(passage, 41, 30)" if a else "CASE WHEN doc_id % 3 = 0 THEN substr(passage, 43, 30) ELSE substr(passage, 41, 30) END"
    return rf"""base_{run} AS (
  SELECT doc_id, 'd' || doc_id AS doc, source, doc_id % {11 if a else 19} = 0 AS failed, regexp_extract_all(coalesce(text, ''), '(?s).{{1,{PAGE_CHARS}}}') AS raw
  FROM documents{f" WHERE doc_id NOT IN {GAPS[run]}" if gaps else ""}
), own_{run} AS (
  SELECT *, ((doc_id * 7919) % greatest(len(raw), 1))::INT AS at_page, coalesce(raw[((doc_id * 7919) % greatest(len(raw), 1)) + 1], '') AS own FROM base_{run}
), passage_{run} AS (
  SELECT *, substr(own, (doc_id * 31) % greatest(length(own) - {PASSAGE - 1}, 1) + 1, {PASSAGE}) AS passage, list_transform(raw, lambda x: {strip("x")}) AS pages FROM own_{run}
), rec_{run} AS (
  SELECT doc_id, doc, source, 'run_{run}' AS run_id, '{"first_pages" if a else "semantic"}' AS strategy, '{"v_full" if a else "v_sem_fewshot"}' AS prompt_variant, {"0.0" if a else "0.7"}::DOUBLE AS temperature,
    array_to_string(list_transform(pages, lambda x, i: '[p. ' || i || ']' || chr(10) || x), chr(10) || chr(10)) AS context_text, pages, failed,
    CASE WHEN failed THEN 'failed' WHEN doc_id % 9 = 0 THEN 'repaired' ELSE 'ok' END AS parse_status,
    NOT failed AND doc_id % 6 <> 0 AS first_try,
    CASE WHEN NOT failed THEN substr(passage, 1, 40) END AS problem, CASE WHEN NOT failed THEN {data} END AS data,
    CASE WHEN NOT failed THEN substr(passage, 71, 30) END AS method, CASE WHEN NOT failed THEN substr(passage, 1, 20) END AS metric,
    CASE WHEN NOT failed AND doc_id % {5 if a else 10} <> 0 THEN 'limited by ' || substr(passage, 5, 20) END AS limitation,
    CASE WHEN NOT failed THEN CASE WHEN doc_id % 7 = 0 OR length(passage) <= 40 THEN '{NOWHERE}' ELSE {strip("substr(passage, 21, 60)")} END END AS quote,
    CASE WHEN NOT failed THEN CASE WHEN doc_id % 13 = 0 THEN len(raw) + 1 ELSE at_page + 1 END END AS page,
    (length(context_text) + 500)::BIGINT AS input_tokens, (doc_id % 50 + 100)::BIGINT AS output_tokens, (doc_id % 10) / 10.0::DOUBLE AS latency_s
  FROM passage_{run}
)"""


#: The normal form for comparing, as far as the standard tables' characters need it.
FORM_SQL = r"""replace(regexp_replace(regexp_replace(regexp_replace(lower({x}), '\s+', ' ', 'g'), '^ | $', '', 'g'), ' ([.,;:!?)\]}}])', '\1', 'g'), 'ß', 'ss')"""


def form_sql(x: str) -> str:
    return rf"regexp_replace({FORM_SQL.format(x=x)}, ' ?- ?', '-', 'g')"


def fidelity_sql(run: str) -> str:
    """found, method, page_claimed and page_found where the exact search decides: the claimed page if it holds the quote, else that of the first place."""
    return f"""forms_{run} AS (SELECT run_id, doc, doc_id, failed, page, list_transform(pages, lambda x: {form_sql("x")}) AS forms, {form_sql("quote")} AS q FROM rec_{run}),
where_{run} AS (SELECT *, CASE WHEN NOT failed THEN strpos(array_to_string(forms, ' '), q) ELSE 0 END AS pos, coalesce(contains(forms[page], q), false) AS on_claimed FROM forms_{run}),
ends_{run} AS (SELECT doc, p, sum(length(f) + 1) OVER (PARTITION BY doc ORDER BY p ROWS UNBOUNDED PRECEDING) AS until FROM (SELECT doc, generate_subscripts(forms, 1) AS p, unnest(forms) AS f FROM where_{run} WHERE pos > 0 AND NOT on_claimed)),
first_{run} AS (SELECT doc, min(p) AS p FROM ends_{run} JOIN where_{run} USING (doc) WHERE pos <= until GROUP BY doc),
fid_{run} AS (
  SELECT w.run_id, w.doc, w.doc_id, w.pos > 0 AS found, CASE WHEN w.failed THEN 'none' WHEN w.pos > 0 THEN 'exact' ELSE 'fuzzy' END AS method, w.page AS page_claimed,
    CASE WHEN w.pos > 0 THEN CASE WHEN w.on_claimed THEN w.page ELSE f.p END END AS page_found
  FROM where_{run} w LEFT JOIN first_{run} f USING (doc))"""
