"""Nearest vectors through an inverted file: lists around centroids, of which each query looks into a few.

Centroids are learned by spherical k-means from a bounded sample, the vectors of smallest hash, and are all that is
sent to tasks.  The sample also says how many lists a query must look into: as few as find ``RECALL`` of its own
nearest neighbours.  Every vector is assigned to its nearest centroid's list, and every query to the
lists of its ``probes`` nearest; both meet in a shuffle by list, where exact products rank them.  A list with more
vectors or queries than ``CAP`` is dealt out to a grid of shards, each vector meeting each query once, so
that no group grows with the data.  What is found is exact among the lists looked into; ``probes`` of all
lists makes it exact altogether.

Null vectors are in no list and find nothing; equal scores go to the smaller id; repeated rows are all ranked.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritome.operators.spans import best_k
from veritome.shipping import cut, reach_workers

#: Vectors of the sample, lists at most, rounds of k-means, rows of a shard.
SAMPLE, MAX_LISTS, ROUNDS, CAP = 16_384, 1024, 12, 8192
#: Share of the sample's nearest neighbours that its lists must find, and how many of the sample ask.
RECALL, ASKING = 0.95, 512


class Lists(NamedTuple):
    centres: np.ndarray
    probes: int


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1).astype(np.float32) if len(flat) else np.zeros((0, 1), np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def probes_of(x: np.ndarray, centres: np.ndarray, k: int, recall: float = RECALL) -> int:
    """The fewest lists that hold ``recall`` of the ``k`` nearest neighbours, among themselves, of vectors ``x``."""
    if len(x) < 2 or len(centres) < 2:
        return max(1, len(centres))
    asking = x[:: max(1, len(x) // ASKING)][:ASKING]
    near = np.argpartition(-(asking @ x.T), min(k, len(x) - 1), axis=1)[:, :k]
    order = np.argsort(-(asking @ centres.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None, :], axis=1)
    needed = np.sort(np.take_along_axis(place, (x @ centres.T).argmax(axis=1)[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


def fit(vectors: DataFrame, k: int, n_lists: int | None = None, *, sample: int = SAMPLE, seed: int = 7) -> Lists:
    """Lists for the ``k`` nearest of (id, vector) rows, from ``sample`` of them: as many as the square root of all rows, ``MAX_LISTS`` at most."""
    known = vectors.filter(F.col("vector").isNotNull())
    n = known.count()
    share = F.shiftrightunsigned(F.xxhash64("id"), 11) / F.lit(2.0**53)
    few = known.filter(share < min(1.0, 1.1 * sample / max(n, 1))).orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").collect()
    if not few:
        return Lists(np.zeros((0, 1), np.float32), 1)
    x = _unit(np.array([r["vector"] for r in few], np.float32).reshape(len(few), -1))
    r = np.random.default_rng(seed)
    centres = x[r.choice(len(x), max(1, min(n_lists or round(n**0.5), MAX_LISTS, len(x))), replace=False)]
    for _ in range(ROUNDS):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = _unit(np.where(np.bincount(near, minlength=len(centres))[:, None] > 0, sums, centres))
    return Lists(centres, probes_of(x, centres, k))


def assigned(vectors: DataFrame, centres: np.ndarray, probes: int = 1) -> DataFrame:
    """(id, vector, list): a row for each of a vector's ``probes`` nearest lists."""
    reach_workers(vectors.sparkSession)
    sent = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            if not b.num_rows or not len(own):
                continue
            near = np.argsort(-(_matrix(b.column(1)) @ own.T), axis=1, kind="stable")[:, :probes]
            at = pa.array(np.repeat(np.arange(b.num_rows), near.shape[1]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(near.ravel(), pa.int32())], ["id", "vector", "list"])

    rows = vectors.filter(F.col("vector").isNotNull()).select(F.col("id").cast("long"), F.col("vector").cast("array<float>").alias("vector"))
    return rows.mapInArrow(run, "id long, vector array<float>, list int")


def _dealt(rows: DataFrame, sizes: DataFrame, own: str, other: str) -> DataFrame:
    """Each row in a shard of its own side, repeated for every shard of the other side."""
    placed = rows.join(F.broadcast(sizes), "list")
    shard = F.pmod(F.xxhash64("id"), F.ceil(F.col(own) / CAP)).cast("int")
    return placed.select("id", "vector", "list", shard.alias(f"{own}_shard"), F.explode(F.sequence(F.lit(0), (F.ceil(F.col(other) / CAP) - 1).cast("int"))).alias(f"{other}_shard"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, *, lists: Lists | None = None) -> DataFrame:
    """(query, id, score): the ``k`` nearest of (id, vector) rows to each of the (id, vector) queries, by dot product.

    ``lists`` are fitted unless given; ids are integers.
    """
    centres, probes = fit(vectors, k) if lists is None else lists
    held, asked = cut(assigned(vectors, centres)), cut(assigned(queries, centres, probes))
    # A row per list, MAX_LISTS at most.
    sizes = cut(held.groupBy("list").agg(F.count(F.lit(1)).alias("rows")).join(asked.groupBy("list").agg(F.count(F.lit(1)).alias("queries")), "list"))
    keys = ["list", "rows_shard", "queries_shard"]

    def compare(own: pa.Table, theirs: pa.Table) -> pa.Table:
        out = []
        ids, x = own["id"].to_numpy(), _matrix(own["vector"]).astype(np.float64)
        asking, q = theirs["id"].to_numpy(), _matrix(theirs["vector"]).astype(np.float64)
        for at in range(0, len(q) if len(x) else 0, 512):
            scores = q[at : at + 512] @ x.T
            for row, s in enumerate(scores):
                least = np.partition(s, -k)[-k] if len(s) > k else -np.inf
                near = np.flatnonzero(s >= least)
                best = near[np.lexsort((ids[near], -s[near]))[:k]]
                out.append((np.repeat(asking[at + row], len(best)), ids[best], s[best]))
        columns = [np.concatenate([o[i] for o in out]) if out else np.array([]) for i in range(3)]
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query", "id", "score"])

    pairs = _dealt(held, sizes, "rows", "queries").groupBy(*keys).cogroup(_dealt(asked, sizes, "queries", "rows").groupBy(*keys)).applyInArrow(compare, "query long, id long, score double")
    return best_k(pairs, ["query"], [F.col("score").desc(), F.col("id")], k)
