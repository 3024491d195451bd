"""Interval tools: merged spans, what spans add to those before them, budgets that skip what doesn't fit, best k per group."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritome.shipping import cut, reach_workers

#: Places of a tile, a power of two; rows of a block.
TILE, BLOCK = 256, 4096
#: Chunks of a shard, and scores held at once.
SHARD, CELL = 8192, 1 << 22


def merge_spans(spans: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", *, score: str | None = None, label: str | None = None) -> DataFrame:
    """Islands of overlapping or touching spans per ``keys``: (keys, start, end, n[, score, label]).

    An island has the best score of its members and that member's label, of equals the first.
    """
    order = W.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    numbered = spans.withColumn("_new", fresh).withColumn("_island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    aggs = [F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")]
    if score:
        aggs.append(F.max(score).alias(score))
        if label:
            aggs.append(F.max_by(label, F.struct(F.coalesce(F.col(score), F.lit(0.0)), -F.col(start), -F.col(end))).alias(label))
    return numbered.groupBy(*keys, "_island").agg(*aggs).drop("_island")


def uncovered(spans: DataFrame, keys: Sequence[str], order: Sequence[Column], start: str = "start", end: str = "end") -> DataFrame:
    """``spans`` [start, end) with ``fresh``: how many of its places no span before it in ``order``, which is total per ``keys``, covers.

    A place belongs to the first span that covers it.  Spans are clipped to tiles of ``TILE`` places, and
    since a minimum may count a place twice, two blocks of a power of two cover each clipped span:
    the least order per (tile, size, place) is all that is shuffled, so a tile has at most
    TILE x 9 rows, however many spans a key has.  Blocks then hand their order down to their places.
    """
    rank = F.struct(*(c.alias(f"_o{i}") for i, c in enumerate(order)))
    rows = spans.withColumn("_rank", rank)
    tiles = F.sequence(F.expr(f"floor({start} / {TILE})"), F.expr(f"floor(({end} - 1) / {TILE})"))
    clipped = rows.filter(F.col(end) > F.col(start)).select(*keys, "_rank", F.col(start).alias("_s"), F.col(end).alias("_e"), F.explode(tiles).alias("_tile"))
    low, high = F.greatest(F.col("_s") - F.col("_tile") * TILE, F.lit(0)), F.least(F.col("_e") - F.col("_tile") * TILE, F.lit(TILE))
    size = F.expr("shiftleft(1, length(bin(_high - _low)) - 1)")  # the largest power of two within
    placed = clipped.select(*keys, "_tile", "_rank", low.cast("int").alias("_low"), high.cast("int").alias("_high")).withColumn("_size", size)
    blocks = placed.select(*keys, "_tile", "_rank", "_size", F.explode(F.array_distinct(F.array("_low", F.col("_high") - F.col("_size")))).alias("_at"))
    least = blocks.groupBy(*keys, "_tile", "_size", "_at").agg(F.min("_rank").alias("_rank"))
    places = least.select(*keys, "_tile", "_rank", F.explode(F.sequence(F.col("_at"), F.col("_at") + F.col("_size") - 1)).alias("_at"))
    owners = places.groupBy(*keys, "_tile", "_at").agg(F.min("_rank").alias("_rank")).groupBy(*keys, "_rank").agg(F.count(F.lit(1)).alias("_fresh"))
    owners = owners.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_rank").alias("_owner"), "_fresh")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)), F.col("_rank") == F.col("_owner"))
    return rows.join(owners, same, "left").select(*spans.columns, F.coalesce("_fresh", F.lit(0)).cast("long").alias("fresh"))


def fitting(items: DataFrame, keys: Sequence[str], size: str, order: Sequence[Column], budget: int, *, block: int = BLOCK) -> DataFrame:
    """Rows that a greedy pass takes: in ``order`` each row that still fits in ``budget`` per ``keys``; others, and rows without a size, are skipped.

    A row that doesn't fit doesn't end the pass, so no running total can say this.  Rows are range-sorted by keys
    and order and cut into blocks, of which only (key, block, least size) is looked at: in each round a key goes on with its first
    block that holds a row that fits, all others are skipped whole, and each such block is folded by itself.
    A key's rows lie in many tasks, and no group holds more than ``block`` rows.
    """
    reach_workers(items.sparkSession)
    names = [f"_k{i}" for i in range(len(keys))]
    sort = [*(F.col(k) for k in keys), *order]
    rows = items.filter(items[size] <= budget).repartitionByRange(*sort).sortWithinPartitions(*sort)
    rows = cut(rows.select("*", *(F.struct(F.col(k)).alias(n) for k, n in zip(keys, names, strict=True)), F.col(size).cast("long").alias("_size"), F.monotonically_increasing_id().alias("_seen")).withColumn("_block", F.expr(f"_seen div {block}")))
    least = cut(rows.groupBy(*names, "_block").agg(F.min("_size").alias("_least")))
    state = least.select(*names).distinct().withColumns({"_room": F.lit(budget).cast("long"), "_at": F.lit(-1).cast("long")})

    def fold(group: pa.Table) -> pa.Table:
        group = group.sort_by("_seen")
        room, taken = group["_room"][0].as_py(), np.zeros(group.num_rows, bool)
        for i, n in enumerate(group["_size"].to_pylist()):
            if n <= room:
                taken[i] = True
                room -= n
        kept = group.filter(pa.array(taken)).drop_columns(["_room"])
        return kept.append_column("_room", pa.array([room] * kept.num_rows, pa.int64()))

    done = None
    while True:
        able = least.join(state, names).filter("_block > _at and _least <= _room")
        following = cut(able.groupBy(*names).agg(F.min("_block").alias("_block"), F.first("_room").alias("_room")))
        if following.isEmpty():
            break
        chosen = rows.join(following, [*names, "_block"]).select(*rows.columns, "_room")
        taken = cut(chosen.groupBy(*names).applyInArrow(fold, chosen.schema))
        done = taken if done is None else done.unionByName(taken)
        # A block with a row that fits has one taken, so every key that went on has a new state.
        state = cut(taken.groupBy(*names).agg(F.min("_room").alias("_room"), F.max("_block").alias("_at")))
    return items.limit(0) if done is None else done.select(*items.columns)


def best_k(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows of each group; Spark prunes groups before the shuffle (window group limit)."""
    return rows.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_rank") <= k).drop("_rank")


def top_chunks(chunks: DataFrame, queries: DataFrame, k: int, *, keys: Sequence[str] = ("doc",), max_queries: int = 1000) -> DataFrame:
    """Union of each query's ``k`` nearest chunks per group, with best score and that query's label.

    ``chunks`` have ``chunk`` (its place in the group) and ``vector``; ``queries`` have ``query``
    (its place), ``label`` and ``vector``.  Both are dealt out by hash to a grid of about ``SHARD`` chunks by ``max_queries``
    queries, and each cell sends on the ``k`` best of its groups for each of its queries.
    The work is that of all pairs, the memory that of a cell, and nothing passes through the driver.
    """
    reach_workers(chunks.sparkSession)
    n, n_queries = chunks.count(), queries.count()
    rows, blocks = max(1, -(-n // SHARD), min(chunks.sparkSession.sparkContext.defaultParallelism, n)), max(1, -(-n_queries // max_queries))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    # Under new names, since both may come from one table.
    held = chunks.select(*(F.col(c).alias(c) for c in (*keys, "chunk", "vector")), F.pmod(F.xxhash64(*keys, "chunk"), F.lit(rows)).cast("int").alias("_rows"), every(blocks).alias("_block"))
    asked = queries.select(*(F.col(c).alias(c) for c in ("query", "label", "vector")), F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("_block"), every(rows).alias("_rows"))
    kinds = [*(chunks.schema[c] for c in (*keys, "chunk")), *(queries.schema[c] for c in ("query", "label"))]
    schema = T.StructType([*kinds, T.StructField("score", T.DoubleType())])

    def compare(own: pa.Table, theirs: pa.Table) -> pa.Table:
        group = np.zeros(own.num_rows, np.int64)
        for key in keys:
            codes = own[key].combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            group = np.unique(group * (int(codes.max(initial=0)) + 1) + codes, return_inverse=True)[1]
        own = own.take(pa.array(np.lexsort((own["chunk"].to_numpy(), group))))
        found = list(_nearest_by_group(own["vector"], theirs["vector"], np.sort(group), k)) if own.num_rows and theirs.num_rows else []
        asking, row = (np.concatenate([np.zeros(0, np.int64), *(f[i] for f in found)]) for i in (0, 1))
        score = pa.chunked_array([f[2] for f in found], pa.float64())
        columns = [*(own[c].take(pa.array(row)) for c in (*keys, "chunk")), *(theirs[c].take(pa.array(asking)) for c in ("query", "label")), score]
        return pa.table(columns, schema.names)

    near = held.groupBy("_rows", "_block").cogroup(asked.groupBy("_rows", "_block")).applyInArrow(compare, schema)
    near = best_k(near.withColumnRenamed("label", "_label"), [*keys, "query"], [F.col("score").desc(), F.col("chunk")], k)
    return near.groupBy(*keys, "chunk").agg(F.round(F.max("score"), 6).alias("score"), F.max_by("_label", F.struct("score", -F.col("query"))).alias("label"))


def _padded(vectors: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as doubles, filled up with zeros to the longest, and their lengths, -1 for one that is null or holds a null."""
    lists = vectors.combine_chunks()
    n, items = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64), lists.flatten()
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    out = np.zeros((len(n), int(n.max(initial=0))))
    out[row, place] = items.cast(pa.float64()).fill_null(0.0).to_numpy()
    known = lists.is_valid().to_numpy(zero_copy_only=False)
    known[row[items.is_null().to_numpy(zero_copy_only=False)]] = False
    return out, np.where(known, n, -1)


def _nearest_by_group(own: pa.ChunkedArray, theirs: pa.ChunkedArray, group: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """(queries, rows, scores) of each query's ``k`` best rows in each ``group``; rows are sorted by group, then by place.

    A matrix product tells which rows may be among them, up to its rounding; their products are then summed up one by one in
    the vectors' order, and those sums decide, so neither a score nor a tie depends on the company a row is in.
    The score is null, and last, where lengths differ or a component is null; not-a-number is first.
    """
    (x, long), (q, asks) = _padded(own), _padded(theirs)
    width = max(x.shape[1], q.shape[1])
    x, q = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, q))
    # Both orders of summing are within width units of the last place of the product of the norms.
    norm = lambda m: np.linalg.norm(np.where(np.isfinite(m), m, 0.0), axis=1)
    with np.errstate(all="ignore"):
        slack = 4 * (width + 1) * np.finfo(np.float64).eps * norm(x).max(initial=0) * norm(q)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.r_[starts[1:], len(group)]
    large = ends - starts > k
    few = np.repeat(~large, ends - starts)
    step = max(1, CELL // len(x))
    for at in range(0, len(q), step):
        with np.errstate(all="ignore"):
            rough = q[at : at + step] @ x.T
            rough[np.isnan(rough)] = np.inf
            unknown = (asks[at : at + step, None] != long) | (long < 0)
            rough[unknown] = -np.inf
            may = np.repeat(few[None, :], len(rough), axis=0)
            for a, b in zip(starts[large], ends[large], strict=True):
                least = np.partition(rough[:, a:b], b - a - k, axis=1)[:, b - a - k] - slack[at : at + step]
                may[:, a:b] = rough[:, a:b] >= np.where(np.isnan(least), -np.inf, least)[:, None]
            asking, row = np.nonzero(may)
            score = np.zeros(len(row))
            for j in range(width):
                score += x[row, j] * q[at + asking, j]
        null, odd = unknown[asking, row], np.isnan(score)
        order = np.lexsort((row, -np.where(odd, 0.0, score), ~odd, null, group[row], asking))
        asking, row, score, null = asking[order], row[order], score[order], null[order]
        first = np.flatnonzero(np.r_[True, (asking[1:] != asking[:-1]) | (group[row[1:]] != group[row[:-1]])]) if len(row) else row
        kept = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)])) < k
        yield at + asking[kept], row[kept], pa.array(score[kept], mask=null[kept])
