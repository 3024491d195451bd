"""Extraction: documents to records, one model call per document, and whole studies on top of it."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritome.functions.completion import parsed
from veritome.model import Client, Params, Stub
from veritome.operators import confidence, stats
from veritome.operators.overview import full_texts
from veritome.operators.selection import Strategy, context_pages, rendered, select_contexts
from veritome.prompts import VARIANTS, render_prompts
from veritome.schemas import RECORDS
from veritome.sources.runs import ANSWERS, RunStore


def complete(prompts: DataFrame, client: Client, params: Params, retries: int = 2) -> DataFrame:
    """``prompts`` (doc, system, user) answered: (doc, raw_output, input_tokens, output_tokens, latency_s, call_error).

    A call that keeps failing becomes a row with its error.
    """

    def call(system: str | None, user: str) -> tuple:
        for attempt in range(retries + 1):
            try:
                c = client.generate(system, user, params)
                return c.text, c.input_tokens, c.output_tokens, c.latency_s, None
            except Exception as e:  # recorded in the row
                if attempt == retries:
                    return "", 0, 0, 0.0, f"{type(e).__name__}: {e}"
        raise AssertionError

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # a row at a time: answers leave as they come
                got = call(b.column(1)[i].as_py(), b.column(2)[i].as_py())
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), *(pa.array([v], k) for v, k in zip(got, kinds, strict=True))], ["doc", "raw_output", "input_tokens", "output_tokens", "latency_s", "call_error"])

    return prompts.select("doc", "system", "user").mapInArrow(run, ANSWERS)


def prepare(pages: DataFrame, how: Strategy, variant: str = "v_full") -> DataFrame:
    """(doc, context_text, context_pages, prompt parts, doc_sha256): what is sent for each document."""
    contexts = select_contexts(pages, how).select("doc", rendered(F.col("chunks")).alias("context_text"), context_pages(F.col("chunks")).alias("context_pages"))
    hashes = full_texts(pages).select("doc", F.sha2("text", 256).alias("doc_sha256"))
    return render_prompts(contexts, variant).join(hashes, "doc")


def assemble(prompts: DataFrame, answers: DataFrame, how: Strategy, client: Client, *, run_id: str, variant: str = "v_full", params: Params = Params(), repetition: int = 1) -> DataFrame:
    """Records of prompts and their answers; calls nothing."""
    p = prompts.join(answers, "doc").withColumn("p", parsed(F.col("raw_output"), VARIANTS[variant].chain_of_thought))
    fixed = {
        "run_id": run_id, "strategy": how.name, "prompt_variant": variant, "model": client.model_name, "temperature": params.temperature, "seed": params.seed, "repetition": repetition,
        "created_at": datetime.now(UTC).isoformat(timespec="seconds"),
    }
    rows = p.withColumns({k: F.lit(v) for k, v in fixed.items()}).withColumns(
        {"first_try": F.col("p.first_try"), "parse_status": F.col("p.status"), "card": F.col("p.card"), "repairs": F.col("p.repairs"), "error": F.coalesce("call_error", "p.error"), "seq": F.abs(F.xxhash64("doc"))}
    )
    return rows.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in RECORDS])


def extract(pages: DataFrame, how: Strategy, client: Client, *, run_id: str, variant: str = "v_full", params: Params = Params(), repetition: int = 1, done: DataFrame | None = None) -> DataFrame:
    """Records of one run as one lazy plan, which calls the model anew each time it runs; ``run_and_store`` keeps answers."""
    todo = pages if done is None else pages.join(done.select("doc").distinct(), "doc", "left_anti")
    prompts = prepare(todo, how, variant)
    return assemble(prompts, complete(prompts, client, params), how, client, run_id=run_id, variant=variant, params=params, repetition=repetition)


def run_and_store(
    spark: SparkSession, store: RunStore, pages: DataFrame, how: Strategy, client: Client, *, variant: str = "v_full", params: Params = Params(), repetition: int = 1, resume: str | None = None, wave: int = 1000
) -> str:
    """Extract in waves of about ``wave`` documents, and seal with a manifest that holds the run's summary.  Returns the run id.

    Contexts are selected and prompts written once, by wave, so pages are read once however many waves there are.
    A wave's answers are on disk before anything is joined to them, so a failure loses the calls
    of one wave at most.  Resuming calls the model only for documents without a kept answer.
    """
    run_id = resume or store.new_run_id(how.name, variant, params.temperature, repetition)
    pending = pages.join(store.load(run_id).select("doc").distinct(), "doc", "left_anti")
    waves = max(1, -(-pending.select("doc").distinct().count() // wave))
    prompts = store.keep_prompts(run_id, prepare(pending, how, variant).withColumn("_wave", F.pmod(F.xxhash64("doc"), F.lit(waves)).cast("int")))
    for k in range(waves):
        # A wave's answers are those of its own folder of prompts that aren't kept yet.
        part = prompts.filter(F.col("_wave") == k).join(store.answers(run_id).select("doc").distinct(), "doc", "left_anti")
        store.keep_answers(run_id, complete(part, client, params))
    answers = store.answers(run_id).dropDuplicates(["doc"])
    store.append(assemble(prompts.drop("_wave"), answers, how, client, run_id=run_id, variant=variant, params=params, repetition=repetition))
    summary = stats.run_summary(store.load(run_id), "run_id").first().asDict()
    store.write_manifest(run_id, {"run_id": run_id, "strategy": how.name, "prompt_variant": variant, "model": client.model_name, "generation": params._asdict(), "repetition": repetition, "status": "concluida", "summary": summary})
    return run_id


def rehearse(spark: SparkSession, store: RunStore, pages: DataFrame, how: Strategy, other: Strategy, client: Client = Stub()) -> DataFrame:
    """A whole study: a run, its repetition, the other input, and the audited final table."""
    first = run_and_store(spark, store, pages, how, client)
    again = run_and_store(spark, store, pages, how, client, repetition=2)
    alt = run_and_store(spark, store, pages, other, client)
    rows = confidence.evidence(store.load(first), store.load(again), store.load(alt))
    return confidence.final_table(confidence.assign(rows))
