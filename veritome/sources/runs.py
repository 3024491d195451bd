"""Runs on disk: records as JSON lines per run, a manifest per run, a catalogue of both."""

from __future__ import annotations

import json
from datetime import datetime
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritome.functions.text import format_temperature, slug
from veritome.schemas import RECORDS


#: An answer of a model, as it came.
ANSWERS = "doc string, raw_output string, input_tokens long, output_tokens long, latency_s double, call_error string"


class RunStore:
    """Under ``<root>``: prompts/run_id=..., answers/run_id=..., records/run_id=..., manifests/run_id=...."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def new_run_id(self, strategy: str, variant: str, temperature: float, repetition: int = 1, now: datetime | None = None) -> str:
        """``<stamp>_<strategy>_<variant>_t<temperature>_rep<n>``; a taken id gets _2, _3 and so on."""
        one = self.spark.range(1).select(F.concat_ws("_", slug(F.lit(strategy)), slug(F.lit(variant)), F.concat(F.lit("t"), format_temperature(F.lit(temperature))))).first()[0]
        base = f"{(now or datetime.now()):%Y%m%d-%H%M%S}_{one}_rep{repetition}"
        taken, name, k = set(self.list_runs()), base, 2
        while name in taken:
            name, k = f"{base}_{k}", k + 1
        return name

    def append(self, records: DataFrame) -> None:
        """Append records, each to its run; the commit protocol makes an append whole or nothing."""
        names = [f.name for f in RECORDS]
        records.select(names).write.mode("append").partitionBy("run_id").json(f"{self.root}/records")

    def keep_prompts(self, run_id: str, prompts: DataFrame) -> DataFrame:
        """Write a run's prompts, a folder per ``_wave``, and read them back; those of an earlier attempt are replaced."""
        place = f"{self.root}/prompts/run_id={run_id}"
        prompts.write.mode("overwrite").partitionBy("_wave").parquet(place)
        return self.spark.read.schema(prompts.schema).parquet(place)

    def keep_answers(self, run_id: str, answers: DataFrame) -> None:
        """Append answers of a run as they came, whole or nothing."""
        answers.write.mode("append").parquet(f"{self.root}/answers/run_id={run_id}")

    def answers(self, run_id: str) -> DataFrame:
        """Kept answers of a run, none before the first."""
        if run_id not in self._names("answers"):
            return self.spark.createDataFrame([], ANSWERS)
        return self.spark.read.schema(ANSWERS).parquet(f"{self.root}/answers/run_id={run_id}")

    def _names(self, part: str) -> set[str]:
        """Runs with a folder in a part of the store, from the file system's listing."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{part}")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return set()
        names = (s.getPath().getName() for s in fs.listStatus(folder))
        return {unquote(n.removeprefix("run_id=")) for n in names if n.startswith("run_id=")}

    def load(self, *run_ids: str) -> DataFrame:
        """Records, of all runs or the given ones.  Files have no order: ``seq`` has it.  Missing repairs are empty."""
        if not self._names("records"):
            return self.spark.createDataFrame([], RECORDS)
        rows = self.spark.read.schema(RECORDS).json(f"{self.root}/records")
        rows = rows.withColumn("repairs", F.coalesce("repairs", F.expr("cast(array() as array<string>)")))
        return rows.filter(F.col("run_id").isin(*run_ids)) if run_ids else rows

    def write_manifest(self, run_id: str, manifest: dict) -> None:
        one = self.spark.range(1).select(F.lit(run_id).alias("run_id"), F.lit(json.dumps(manifest, ensure_ascii=False)).alias("manifest"))
        one.write.mode("overwrite").json(f"{self.root}/manifests/run_id={run_id}")

    def manifests(self) -> DataFrame:
        """(run_id, manifest) with the manifest as JSON text."""
        return self.spark.read.schema("manifest string, run_id string").json(f"{self.root}/manifests")

    def manifest(self, run_id: str) -> dict:
        row = self.manifests().filter(F.col("run_id") == run_id).select("manifest").first()
        if row is None:
            raise FileNotFoundError(f"no manifest of run {run_id}")
        return json.loads(row[0])

    def list_runs(self) -> list[str]:
        """Run ids that have records or a manifest, oldest first; their number is that of runs, not of records."""
        return sorted(self._names("records") | self._names("manifests"))
