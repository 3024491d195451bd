"""Records as a stream: answers are parsed as they land, and runs summed up with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veritome.functions.completion import parsed
from veritome.operators.stats import run_summary

ANSWERS = "run_id string, doc string, raw_output string, input_tokens long, output_tokens long, latency_s double, answered_at timestamp"


def answers(spark: SparkSession, folder: str, *, files_per_trigger: int = 100) -> DataFrame:
    """Raw answers from a folder of JSON lines, a bounded number of files at a time."""
    return spark.readStream.schema(ANSWERS).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def parsed_answers(raw: DataFrame) -> DataFrame:
    """Answers with status, card, first_try and repairs; stateless, so the same for batch and stream."""
    p = raw.withColumn("p", parsed(F.col("raw_output")))
    return p.select("run_id", "doc", "input_tokens", "output_tokens", "latency_s", "answered_at", F.col("p.status").alias("parse_status"), F.col("p.card").alias("card"), F.col("p.first_try").alias("first_try"), F.col("p.repairs").alias("repairs"))


def unique_answers(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    """One answer per run and document; a retry within the watermark is dropped, older state is let go."""
    return rows.withWatermark("answered_at", late).dropDuplicatesWithinWatermark(["run_id", "doc"])


def summary_per_window(rows: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Run summaries per window of answer time; a window closes when the watermark has passed it."""
    timed = rows.withWatermark("answered_at", late).withColumn("window", F.window("answered_at", window))
    return run_summary(timed, "run_id", "window").select("run_id", F.col("window.start").alias("window_start"), "n", "n_ok", "n_repaired", "n_failed", "n_first_try", "input_tokens", "output_tokens")


def store_stream(rows: DataFrame, path: str, checkpoint: str, *, available_now: bool = False) -> StreamingQuery:
    """Append parsed answers to Parquet, exactly once, per run."""
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("run_id").outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
