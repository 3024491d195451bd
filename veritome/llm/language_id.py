"""Language identification by a byte convolutional network trained in numpy.

A text's UTF-8 bytes, A-Z lowered, are cut into windows of ``WINDOW`` bytes, the last one filled up
with zeros.  Bytes are embedded, filters of several widths run over them, each filter's largest
response in the window is kept, and a softmax over these says how likely each language is.  All
windows of all texts pass through the network in batches of fixed size; a document's probabilities are the
mean of its windows', weighted by the bytes of letters in them.

The network is trained on a bounded sample of labelled documents: of each language the ids of smallest
hash, ``PER_LANGUAGE`` at most and fewer if ``MAX_SAMPLE`` documents wouldn't hold all languages, and
of each ``PER_DOCUMENT`` windows spread over its whole text.  That is what the driver holds; every
document is then judged.  Language, source and id are never inputs of a prediction.

Defined results: a text that is null, empty or without a letter (a character that Unicode counts as
one) is ``und`` with score 0, and so is every text if there is nothing to learn from; a null
language isn't learned from, an empty one is a language like others; an id with several texts of a
language teaches the smallest, with several languages each of them; equal probabilities go to the language that sorts first;
repeated rows get equal results; an empty table gives an empty result; other columns are
ignored, whatever their names; a very long text is judged by all its windows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veritome.llm.bpe import slices
from veritome.llm.common import cut, table, whole_texts
from veritome.llm.quality_knn import learns

WINDOW, EMBEDDED, WIDTHS, FILTERS = 128, 8, (2, 3, 4, 5), 16
PER_LANGUAGE, MAX_SAMPLE, PER_DOCUMENT = 400, 20_000, 16
STEPS, BATCH, RATE, SEED = 500, 128, 4e-3, 13
#: Windows that pass through the network at a time.
BLOCK = 128
UNKNOWN = "und"
_WIDE = max(WIDTHS)
#: Which bytes of a patch each filter sees.
_SEEN = np.repeat(np.arange(_WIDE)[:, None] < np.repeat(WIDTHS, FILTERS)[None, :], EMBEDDED, axis=0)
_LETTER = np.array([97 <= b < 123 or b >= 128 for b in range(256)])


class Network(NamedTuple):
    languages: list[str]
    embedding: np.ndarray  # byte, dimension
    filters: np.ndarray  # byte of the patch and dimension, filter
    bias: np.ndarray
    out: np.ndarray  # filter, language
    out_bias: np.ndarray


def windows(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of all texts as rows of bytes, and how many each text has."""
    raw = [t.encode().lower().replace(b"\0", b" ") for t in texts]
    n = np.array([-(-len(r) // WINDOW) for r in raw], np.int64)
    whole = b"".join(r.ljust(k * WINDOW, b"\0") for r, k in zip(raw, n.tolist(), strict=True))
    return np.frombuffer(whole, np.uint8).reshape(-1, WINDOW), n


def _patches(net: Network, rows: np.ndarray) -> np.ndarray:
    """Every place's next bytes, embedded: (places of all rows, bytes of a patch times dimensions)."""
    wide = np.zeros((len(rows), WINDOW + _WIDE - 1, EMBEDDED), np.float32)
    wide[:, :WINDOW] = net.embedding[rows]
    flat = wide.reshape(len(rows), -1)
    view = np.lib.stride_tricks.sliding_window_view(flat, _WIDE * EMBEDDED, axis=1)[:, ::EMBEDDED]
    return np.ascontiguousarray(view).reshape(-1, _WIDE * EMBEDDED)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def probabilities(net: Network, rows: np.ndarray) -> np.ndarray:
    """Of each window, the probability of each language."""
    out = np.empty((len(rows), len(net.languages)), np.float32)
    for at in range(0, len(rows), BLOCK):
        part = rows[at : at + BLOCK]
        best = (_patches(net, part) @ net.filters).reshape(len(part), WINDOW, -1).max(axis=1)
        out[at : at + BLOCK] = _softmax(np.maximum(best + net.bias, 0) @ net.out + net.out_bias)
    return out


def train(rows: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = STEPS, seed: int = SEED) -> Network:
    """Adam on cross-entropy; batches draw languages evenly and cut some windows short, as texts' last ones are."""
    r = np.random.default_rng(seed)
    n = len(WIDTHS) * FILTERS
    params = [r.normal(0, 0.5, (256, EMBEDDED)), r.normal(0, 0.25, (_WIDE * EMBEDDED, n)) * _SEEN, np.zeros(n), r.normal(0, 0.2, (n, len(languages))), np.zeros(len(languages))]
    params = [p.astype(np.float32) for p in params]
    params[0][0] = 0
    first, second = ([np.zeros_like(p) for p in params] for _ in range(2))
    own = [np.flatnonzero(labels == i) for i in range(len(languages))]
    for step in range(1, steps + 1):
        said = r.integers(0, len(languages), BATCH)
        part = rows[[r.choice(own[i]) for i in said]].copy()
        ends = np.where(r.random(BATCH) < 0.3, r.integers(12, WINDOW, BATCH), WINDOW)
        part[np.arange(WINDOW)[None, :] >= ends[:, None]] = 0
        net = Network(languages, *params)
        patches = _patches(net, part).reshape(BATCH, WINDOW, -1)
        answers = patches @ net.filters
        where = answers.argmax(axis=1)
        best = np.take_along_axis(answers, where[:, None], axis=1)[:, 0] + net.bias
        kept = np.maximum(best, 0)
        grad = _softmax(kept @ net.out + net.out_bias)
        grad[np.arange(BATCH), said] -= 1
        grad /= BATCH
        d_best = (grad @ net.out.T) * (best > 0)
        seen = patches[np.arange(BATCH)[:, None], where]  # window, filter, patch
        d_filters = np.einsum("bf,bfk->kf", d_best, seen) * _SEEN
        d_seen = (d_best[:, :, None] * net.filters.T[None]).reshape(-1, EMBEDDED)
        filled = np.zeros((BATCH, WINDOW + _WIDE - 1), np.uint8)
        filled[:, :WINDOW] = part
        their = filled[np.arange(BATCH)[:, None, None], where[:, :, None] + np.arange(_WIDE)].ravel()
        d_embedding = np.stack([np.bincount(their, d_seen[:, k], 256) for k in range(EMBEDDED)], axis=1).astype(np.float32)
        d_embedding[0] = 0
        rate = RATE * (1 - 0.9 * step / steps)
        for i, g in enumerate((d_embedding, d_filters, d_best.sum(axis=0), kept.T @ grad, grad.sum(axis=0))):
            first[i] += 0.1 * (g - first[i])
            second[i] += 0.001 * (g * g - second[i])
            params[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Network(languages, *params)


def _spread(text: str, k: int) -> list[bytes]:
    """``k`` windows at most, spread over the whole text, of those with a letter."""
    rows, _ = windows([text])
    rows = rows[_LETTER[rows].any(axis=1)]
    return [w.tobytes() for w in rows[np.linspace(0, len(rows) - 1, min(k, len(rows))).round().astype(int)]] if len(rows) else []


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, learned: Column | None = None, per_language: int = PER_LANGUAGE, max_sample: int = MAX_SAMPLE) -> Network | None:
    """The network learned from a bounded sample of the rows that ``learned`` allows; None if they teach nothing."""
    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text"), docs[lang_col].cast("string").alias("_lang"), (F.lit(True) if learned is None else learned).alias("_own"))
    known = rows.filter(F.col("_own") & F.col("_lang").isNotNull() & F.col("_text").rlike(r"\p{L}")).select("_id", "_lang")
    counts = cut(known.groupBy("_lang").agg(F.count(F.lit(1)).alias("_rows")))  # a row per language, as many as the network has outputs
    n = counts.count()
    if not n:
        return None
    most = max(1, min(per_language, max_sample // n))
    # Only hashes in the lowest share, of twice as many rows as wanted, are ranked, so that no task ranks a language.
    low = F.shiftrightunsigned(F.xxhash64("_id"), 11) / F.lit(2.0**53)
    near = known.join(F.broadcast(counts), "_lang").filter(low < (2 * most + 50) / F.col("_rows")).select("_id", "_lang").distinct()
    least = W.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id")
    picked = near.withColumn("_rank", F.row_number().over(least)).filter(F.col("_rank") <= most).select(F.col("_id").alias("_picked"), F.col("_lang").alias("_as"))
    sample = rows.filter("_own").select("_id", "_lang", "_text").join(F.broadcast(picked), F.col("_id").eqNullSafe(F.col("_picked")) & (F.col("_lang") == F.col("_as")), "left_semi")
    sample = sample.filter(F.col("_text").isNotNull()).groupBy("_id", "_lang").agg(F.min("_text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                found = _spread(b.column(2)[i].as_py(), PER_DOCUMENT)
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * len(found), pa.string()), pa.array([b.column(1)[i].as_py()] * len(found), pa.string()), pa.array(found, pa.binary())], ["id", "lang", "bytes"])

    taught = whole_texts(sample.select(F.col("_id").cast("string"), "_lang", "_text")).mapInArrow(run, "id string, lang string, bytes binary")
    got = sorted((r["lang"], r["id"] or "", bytes(r["bytes"])) for r in taught.collect())  # max_sample x PER_DOCUMENT windows at most
    if not got:
        return None
    languages = sorted({g[0] for g in got})
    return train(np.frombuffer(b"".join(g[2] for g in got), np.uint8).reshape(-1, WINDOW), np.array([languages.index(g[0]) for g in got]), languages)


def judged(net: Network | None, texts: Sequence[str]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    said, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    at = [i for i, t in enumerate(texts) if any(map(str.isalpha, t))] if net else []
    if at:
        rows, n = windows([texts[i] for i in at])
        letters = _LETTER[rows].sum(axis=1)
        starts = np.cumsum(n) - n
        total = np.add.reduceat(probabilities(net, rows) * letters[:, None].astype(np.float64), starts)
        mean = total / np.add.reduceat(letters, starts)[:, None]
        best = mean.argmax(axis=1)
        score[at] = np.clip(mean[np.arange(len(at)), best], 0, 1).round(6)
        for i, k in zip(at, best.tolist(), strict=True):
            said[i] = net.languages[k]
    return said, score


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in slices(batches):
            said, score = judged(sent.value, texts)
            yield pa.RecordBatch.from_arrays([keys, pa.array(said, pa.string()), pa.array(score, pa.float64())], ["_id", "lang_pred", "score"])

    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text"))
    schema = rows.select("_id", F.col("_text").alias("lang_pred"), F.lit(None).cast("double").alias("score")).schema
    return whole_texts(rows).mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs, learned=learns(docs["doc_id"])))
    return found.select("doc_id", (~learns(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")
