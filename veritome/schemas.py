"""Shapes of the tables that operators exchange.

Pages are (doc, page, text); a context is one row per document with its chosen chunks; records
are the fact table, one row per run and document.
"""

from __future__ import annotations

from pyspark.sql import types as T

from veritome.functions.completion import CARD

PAGES = T.StructType([T.StructField("doc", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("text", T.StringType())])

CHUNK = T.StructType(
    [
        T.StructField("page", T.IntegerType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("label", T.StringType()),
    ]
)

RECORDS = T.StructType(
    [
        *(T.StructField(n, T.StringType()) for n in ("run_id", "doc", "strategy", "prompt_variant", "prompt_sha", "model")),
        T.StructField("temperature", T.DoubleType()),
        T.StructField("seed", T.LongType()),
        T.StructField("repetition", T.IntegerType()),
        T.StructField("seq", T.LongType()),
        T.StructField("context_text", T.StringType()),
        T.StructField("context_pages", T.ArrayType(T.IntegerType())),
        T.StructField("raw_output", T.StringType()),
        T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
        T.StructField("latency_s", T.DoubleType()),
        T.StructField("first_try", T.BooleanType()),
        T.StructField("parse_status", T.StringType()),
        T.StructField("card", CARD),
        T.StructField("error", T.StringType()),
        T.StructField("repairs", T.ArrayType(T.StringType())),
        T.StructField("doc_sha256", T.StringType()),
        T.StructField("created_at", T.StringType()),
    ]
)

#: Compared fields of a card, in order, and how to reach them.
FIELDS = {
    "problem": "card.problem",
    "data": "card.data",
    "method": "card.method",
    "metric": "card.metric",
    "limitation": "card.limitation",
    "evidence.quote": "card.evidence.quote",
    "evidence.page": "card.evidence.page",
}
TEXT_FIELDS = [f for f in FIELDS if f != "evidence.page"]
#: Columns that hold whole texts: they stay out of joins.
TEXTS = ("context_text", "raw_output")
STATUSES = ("ok", "repaired", "failed")
#: Field names of the shipped table.
EXPORT_NAMES = {
    "doc": "arquivo", "problem": "problema", "data": "dados", "method": "metodo", "metric": "metrica", "limitation": "limitacao",
    "quote": "evidencia_trecho", "page": "evidencia_pagina", "confidence": "confianca",
}
