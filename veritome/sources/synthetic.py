"""A deterministic corpus of invented articles with known truth, from expressions over a range."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOPICS = ("river floods", "crop yields", "sea ice", "city noise", "bird songs")


def corpus(spark: SparkSession, n: int = 5, seed: int = 42) -> DataFrame:
    """(doc, page, text) of ``n`` articles of four pages; those with odd numbers declare a limitation."""
    ids = spark.range(1, n + 1)
    pick = F.element_at(F.array(*map(F.lit, TOPICS)), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(len(TOPICS))) + 1).cast("int"))
    size = F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(900)) + 100
    head, foot = F.lit("Journal of Invented Results\n"), lambda page: F.concat(F.lit(f"\nPage {page}"))
    t = F.col("topic")
    odd = F.col("id") % 2 == 1
    texts = (
        F.concat(F.lit("Abstract\nWe study "), t, F.lit(" with a new measure. It works on all sites.\n\n1 Introduction\nEarlier work on "), t, F.lit(" left the cause open.")),
        F.concat(F.lit("2 Data\nWe use "), size.cast("string"), F.lit(" daily records of "), t, F.lit(" from 2001 to 2020.\n\n3 Methods\nA regres-\nsion on state-of-the-\nart features.")),
        F.concat(F.lit("4 Results\nThe error falls by a fifth on "), t, F.lit("."), F.when(odd, F.concat(F.lit("\n\n5 Limitations\nThis study is limited by the small number of sites with "), t, F.lit("."))).otherwise("")),
        F.concat(F.lit("6 Conclusion\nThe measure explains "), t, F.lit(" better than before.\n\nReferences\n[1] A. Author, 2019.")),
    )
    pages = F.array(*(F.struct(F.lit(i).alias("page"), F.concat(head, x, foot(i)).alias("text")) for i, x in enumerate(texts, 1)))
    return ids.withColumn("topic", pick).select(F.format_string("artigo_%02d.pdf", "id").alias("doc"), F.inline(pages))


def truth(spark: SparkSession, n: int = 5) -> DataFrame:
    """(doc, declares): whether an article declares a limitation."""
    return spark.range(1, n + 1).select(F.format_string("artigo_%02d.pdf", "id").alias("doc"), (F.col("id") % 2 == 1).alias("declares"))
