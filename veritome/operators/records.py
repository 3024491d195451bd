"""Records as a table: by document, distinct documents, parsed again from their raw output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritome.functions.completion import parsed


def by_document(records: DataFrame, *columns: str) -> DataFrame:
    """(doc, records): each document's records in order of ``seq``, as structs of ``columns`` (all but texts by default)."""
    from veritome.schemas import TEXTS

    names = columns or tuple(c for c in records.columns if c not in ("doc", "seq", *TEXTS))
    rows = F.array_sort(F.collect_list(F.struct("seq", "run_id", *(c for c in names if c != "run_id"))))
    return records.groupBy("doc").agg(rows.alias("records"))


def document_names(records: DataFrame) -> DataFrame:
    return records.select("doc").distinct().orderBy("doc")


def reparse(records: DataFrame, chain_of_thought: bool = False) -> DataFrame:
    """Records with status, card, first_try, repairs and error as today's parser finds them; the raw output is never changed."""
    p = records.withColumn("_p", parsed(F.col("raw_output"), chain_of_thought))
    return p.withColumns({"parse_status": F.col("_p.status"), "card": F.col("_p.card"), "first_try": F.col("_p.first_try"), "repairs": F.col("_p.repairs"), "error": F.col("_p.error")}).drop("_p")


def flat_cards(records: DataFrame) -> DataFrame:
    """(doc, problem, data, method, metric, limitation, quote, page) of records with a card."""
    return records.filter("card is not null").select("doc", *(f"card.{c}" for c in ("problem", "data", "method", "metric", "limitation")), "card.evidence.quote", "card.evidence.page")
