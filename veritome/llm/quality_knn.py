"""Quality classification by nearest-neighbour voting over latent-semantic vectors.

A text becomes counts of hashed words, hashed word shapes and a few bucketed shares of the
whole (capitals, symbols, repeated words, word length), each block scaled to unit length.
A bounded sample of labelled rows, at most ``per_class`` of each label, weights these features
by inverse document frequency in the sample and reduces them by singular value decomposition
to ``rank`` dimensions.  The projection and the labelled vectors, of fixed size, go to every
worker.  Every document's vector is multiplied with all labelled vectors in blocks, exactly,
and the ``k`` nearest vote with their cosines as weights.

The sample takes the labelled ids of smallest keyed hash, so it doesn't depend on order or
partitions.  Labels, language, source and id never enter a vector.

Defined results: null text counts as empty; an empty text has no vector and gets score 0.5;
ids with contradicting labels count as label 0, null labels and labels of other values are
left out; if the sample lacks a class every score is the share of label 1 in it, 0.5 without
any label; repeated rows get equal scores; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritome.llm.bpe import slices
from veritome.llm.common import table, whole_texts

WORDS, SHAPES = 3072, 960
#: Bucketed shares: four measures of sixteen buckets.
MEASURES, BUCKETS = 4, 16
#: Shares are taken as if so many plain letters or words were added, so that a few words don't look extreme.
PAD = 20
DIMS = WORDS + SHAPES + MEASURES * BUCKETS
BLOCK_WEIGHTS = (1.0, 1.5, 1.0)
PER_CLASS, RANK, NEIGHBOURS, THRESHOLD = 1024, 64, 31, 0.7
MAX_KNOWN = 200_000
_SHAPE = bytes(65 if 65 <= b < 91 else 97 if 97 <= b < 123 or b >= 128 else 48 if 48 <= b < 58 else b for b in range(256))


class Model(NamedTuple):
    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float


class Features:
    """Feature rows of texts; words seen before are remembered up to a fixed number."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    @staticmethod
    def _of_word(w: bytes) -> int:
        shape, last = bytearray(), None
        for c in w.translate(_SHAPE):
            if c != last:
                shape.append(c)
                last = c
        return crc32(w.lower()) % WORDS + WORDS * (crc32(bytes(shape)) % SHAPES)

    def rows(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), DIMS), np.float32)
        known = self.known  # word to the sum of WORDS * shape number and word number
        for row, t in zip(out, texts, strict=True):
            raw = t.encode()
            words = raw.split()
            if not words:
                continue
            distinct = set(words)
            if new := [w for w in distinct if w not in known]:
                if len(known) > MAX_KNOWN:
                    known.clear()
                    new = [*distinct]
                known.update((w, self._of_word(w)) for w in new)
            shape, word = np.divmod(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), WORDS)
            n = len(raw) - len(words) + 1
            letters, capitals = len(raw.translate(None, _NOT_LETTER)), len(raw.translate(None, _NOT_CAPITAL))
            symbols = len(raw.translate(None, _PLAIN))
            for m, share in enumerate((capitals / (letters + PAD), symbols / (n + PAD), (len(words) - len(distinct)) / (len(words) + PAD), (n + 7 * PAD) / (len(words) + PAD) / 32)):
                row[WORDS + SHAPES + m * BUCKETS + min(BUCKETS - 1, int(min(share, 1.0) ** 0.5 * BUCKETS))] = 1.0
            row[:WORDS] = np.bincount(word, minlength=WORDS)
            row[WORDS : WORDS + SHAPES] = np.bincount(shape, minlength=SHAPES)
        np.log1p(out[:, : WORDS + SHAPES], out=out[:, : WORDS + SHAPES])
        return out


_NOT_LETTER = bytes(b for b in range(128) if not (65 <= b < 91 or 97 <= b < 123))
_NOT_CAPITAL = bytes(b for b in range(256) if not 65 <= b < 91)
_PLAIN = bytes(b for b in range(256) if b >= 128 or 48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b in b" \t\n\v\f\r.,;:'\"?()-")


def _scaled(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weighted rows, each block of unit length times its weight."""
    out = rows * idf
    at = 0
    for size, weight in zip((WORDS, SHAPES, MEASURES * BUCKETS), BLOCK_WEIGHTS, strict=True):
        block = out[:, at : at + size]
        norm = np.linalg.norm(block, axis=1, keepdims=True)
        block *= np.divide(weight, norm, out=np.zeros_like(norm), where=norm > 0)
        at += size
    return out


def _unit(v: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0).astype(np.float32)


def fit(rows: np.ndarray, labels: np.ndarray, rank: int = RANK) -> Model:
    """LSA of the sample through the eigenvectors of its Gram matrix."""
    if not len(labels) or len(set(labels.tolist())) < 2:
        return Model(np.ones(DIMS, np.float32), np.zeros((DIMS, 1), np.float32), np.zeros((0, 1), np.float32), labels, float(labels.mean()) if len(labels) else 0.5)
    idf = np.log((1 + len(rows)) / (1 + (rows > 0).sum(axis=0))).astype(np.float32) + 1
    x = _scaled(rows, idf)
    values, left = np.linalg.eigh((x @ x.T).astype(np.float64))
    keep = [i for i in np.argsort(values)[::-1][:rank] if values[i] > 1e-6]
    projection = (x.T @ (left[:, keep] / np.sqrt(values[keep]))).astype(np.float32)
    return Model(idf, projection, _unit(x @ projection), labels.astype(np.float32), float(labels.mean()))


def scores(model: Model, rows: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """Share of label 1 among the ``k`` nearest, weighted by cosine."""
    if not len(model.vectors):
        return np.full(len(rows), model.prior)
    cosine = _unit(_scaled(rows, model.idf) @ model.projection) @ model.vectors.T
    k = min(k, cosine.shape[1])
    near = np.argpartition(cosine, -k, axis=1)[:, -k:]
    weight = np.clip(np.take_along_axis(cosine, near, axis=1), 0, 1).astype(np.float64)
    total = weight.sum(axis=1)
    out = np.divide((weight * model.labels[near]).sum(axis=1), total, out=np.full(len(rows), 0.5), where=total > 0)
    return np.clip(out, 0.0, 1.0)


def learns(id_: Column) -> Column:
    """Whether a labelled id may be learned from; the others are held out."""
    return F.crc32(F.encode(F.coalesce(id_.cast("string"), F.lit("")), "UTF-8")) % 4 != 2


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, per_class: int = PER_CLASS, rank: int = RANK) -> Model:
    """Fit on at most ``per_class`` rows of each label; what reaches the driver is 2 x per_class sparse rows."""
    known = labels.filter(labels[label_col].isin(0, 1) & labels[id_col].isNotNull() & learns(labels[id_col]))
    one = known.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_label")).withColumn("_h", F.xxhash64("_id"))
    picked = None
    for label in (0, 1):
        few = one.filter(F.col("_label") == label).orderBy("_h", "_id").limit(per_class)
        picked = few if picked is None else picked.unionByName(few)
    sample = docs.select(docs[id_col].alias("_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_text")).join(F.broadcast(picked.drop("_h")), "_id")
    sample = sample.groupBy("_id").agg(F.min("_text").alias("_text"), F.min("_label").alias("_label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in batches:
            for i in range(b.num_rows):
                row = features.rows([b.column(1)[i].as_py()])[0]
                at = np.flatnonzero(row)
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()], pa.string()), pa.array([b.column(2)[i].as_py()], pa.int32()), pa.array([at], pa.list_(pa.int32())), pa.array([row[at]], pa.list_(pa.float32()))], ["id", "label", "at", "value"])

    found = sample.select(F.col("_id").cast("string"), "_text", F.col("_label").cast("int")).mapInArrow(run, "id string, label int, at array<int>, value array<float>").collect()
    found.sort(key=lambda r: r["id"])
    rows = np.zeros((len(found), DIMS), np.float32)
    for row, r in zip(rows, found, strict=True):
        row[r["at"]] = r["value"]
    return fit(rows, np.array([r["label"] for r in found], np.float32), rank)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *, keep: list[str] | None = None, score_col: str = "score", block: int = 256) -> DataFrame:
    """Columns ``keep`` (the id by default) of ``docs`` with ``score_col``."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    names = keep or [id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, own = Features(), sent.value
        for b in batches:
            got = []
            for _, texts in slices(iter([b])):
                for at in range(0, len(texts), block):
                    part = texts[at : at + block]
                    empty = np.array([not t.strip(" \t\n\v\f\r") for t in part])
                    got.append(np.where(empty, 0.5, scores(own, features.rows(part))))
            score = np.concatenate(got) if got else np.empty(0)
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(score, pa.float64())], [*(f"_{i}" for i in range(len(names))), "_score"])

    rows = docs.select(F.lit(0).alias("_none"), docs[text_col].cast("string").alias("_text"), *(docs[f"`{c}`"].alias(f"_{i}") for i, c in enumerate(names)))
    schema = rows.drop("_none", "_text").withColumn("_score", F.lit(0.5).cast("double")).schema
    return whole_texts(rows).mapInArrow(run, schema).toDF(*names, score_col)


def judge(spark: SparkSession, docs: DataFrame, sf_dir: str, keep: list[str] | None = None, score_col: str = "score") -> DataFrame:
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")), keep=keep, score_col=score_col)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(spark, table(spark, sf_dir, "documents"), sf_dir)
    return out.select("doc_id", (~learns(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
