"""Ranked lexical search by sort-based accumulation of integer impacts.

One pass over the texts keeps, of each row that has a term, its length and the counts of the
query terms it holds; rows and lengths and document frequencies are summed up from that index.
A second pass scores it where it lies: a row's terms are replaced by the items that hold them,
the concatenated (item, document, impact) arrays of a slice of rows are radix sorted by a packed
key, and ``numpy.add.reduceat`` sums each (item, document) up.  A task keeps a heap of the
``k`` best rows of each item, so what leaves it doesn't grow with its rows.  These candidates are
range-partitioned by item and rank, so that an item's many candidates lie in many tasks of which
each hands on ``k`` at most, and the best of those are ranked.

Items are a stated set of queries: they are read one by one and searched for in blocks of at most
``MAX_PAIRS`` distinct (item, term) pairs, a block of bounded size at a time being sent to the
tasks.  All rows are scored for every item; none is skipped.

Defined results: a null or empty text, or one without a term, is no document and is not
counted; an item without a term, or whose terms no document holds, has no rows; a term's repeats in
an item count once; equal scores are ranked by ascending id, a null id last; rows that repeat an
id are documents of their own, and items that repeat an id are ranked each for itself, so their
rows repeat; an empty table gives an empty result; other columns are ignored, whatever their
names; a very long text is read in pieces that end between two terms.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veritome.llm.bpe import slices
from veritome.llm.common import cut, table, whole_texts

#: ASCII bytes that belong to terms: digits and letters; so do all bytes of other characters.
_TABLE = bytes(b + 32 if 65 <= b < 91 else b if b >= 128 or 48 <= b < 58 or 97 <= b < 123 else 32 for b in range(256))
TOP = 50
#: Distinct (item, term) pairs of a block of items, bytes of a text read at a time, and (item, document, impact) triples sorted at a time.
MAX_PAIRS, PIECE, TRIPLES = 200_000, 1_000_000, 1 << 20
SCALE, K1, BASE, LENGTH_SHARE = 1_000_000_000, 20, 100, 50


def terms(text: str | None) -> Iterator[list[bytes]]:
    """Terms of ``text`` in order, as lists of bounded size unless a single term is longer."""
    raw = (text or "").encode().translate(_TABLE)
    at = 0
    while at < len(raw):
        end = at + PIECE
        if end < len(raw):
            cut_at = raw.rfind(b" ", at, end)
            end = cut_at if cut_at > at else raw.find(b" ", end)
            end = end if end >= 0 else len(raw)
        if found := raw[at:end].split():
            yield found
        at = end


class Block(NamedTuple):
    """Items of a block: their ids, a number for each of their terms, and per term (by ``starts``) the items that hold it."""

    ids: list
    numbers: dict[bytes, int]
    starts: np.ndarray
    items: np.ndarray


def _blocks(items: DataFrame, id_col: str, text_col: str, max_pairs: int) -> Iterator[Block]:
    rows = items.select(items[id_col].alias("id"), items[text_col].cast("string").alias("text"))
    ids, held, pairs = [], [], 0

    def made() -> Block:
        numbers = {t: i for i, t in enumerate(sorted(set().union(*held)))}
        at = np.array([numbers[t] for ts in held for t in sorted(ts)], np.int64)
        item = np.repeat(np.arange(len(held)), [len(ts) for ts in held])
        order = np.lexsort((item, at))
        return Block(ids, numbers, np.searchsorted(at[order], np.arange(len(numbers) + 1)), item[order])

    for row in rows.toLocalIterator():
        own = {t for piece in terms(row["text"]) for t in piece}
        if held and pairs + len(own) > max_pairs:
            yield made()
            ids, held, pairs = [], [], 0
        if own:
            ids, held, pairs = [*ids, row["id"]], [*held, own], pairs + len(own)
    if held:
        yield made()


def _index(docs: DataFrame, numbers: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(_id, n, terms, counts) of the rows that have a term: their length, and the block's terms they hold."""
    sent = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value.get
        for keys, texts in slices(batches):
            kept, lengths, held = [], [], []
            for i, text in enumerate(texts):
                n, hits = 0, []
                for piece in terms(text):
                    n += len(piece)
                    at = np.fromiter(map(number, piece, repeat(-1)), np.int32, len(piece))
                    hits.append(at[at >= 0])
                if n:
                    kept.append(i), lengths.append(n), held.append(np.unique(np.concatenate(hits), return_counts=True))
            offsets = pa.array(np.cumsum([0, *(len(a) for a, _ in held)]), pa.int32())
            flat = (pa.array(np.concatenate([h[j] for h in held]) if held else [], pa.int32()) for j in (0, 1))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(kept, pa.int32())), pa.array(lengths, pa.int64()), *(pa.ListArray.from_arrays(offsets, x) for x in flat)], ["_id", "n", "terms", "counts"])

    rows = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].cast("string").alias("_text"))
    return whole_texts(rows).mapInArrow(run, "_id long, n long, terms array<int>, counts array<int>")


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable ascending order of unsigned ``keys``, by digits of 16 bits (numpy sorts those by radix)."""
    order = np.arange(len(keys))
    for shift in range(0, int(keys.max(initial=0)).bit_length(), 16):
        order = order[np.argsort((keys[order] >> np.uint64(shift)).astype(np.uint16), kind="stable")]
    return order


def summed(item: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (item, doc) in order with their impacts summed."""
    key = item.astype(np.uint64) * np.uint64(n_docs) + doc.astype(np.uint64)
    order = radix_order(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    total = np.add.reduceat(impact[order], first) if len(first) else np.empty(0, np.int64)
    item, doc = np.divmod(key[first], np.uint64(n_docs))
    return item.astype(np.int64), doc.astype(np.int64), total


class Best:
    """The ``k`` best rows of each item so far: heaps of (score, id known, -id, id), the worst first."""

    def __init__(self, n_items: int, k: int) -> None:
        self.heaps: list[list[tuple]] = [[] for _ in range(n_items)]
        self.k = k

    def add(self, item: np.ndarray, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        """Rows in order of their item."""
        edges = np.searchsorted(item, np.arange(len(self.heaps) + 1))
        for heap, lo, hi in zip(self.heaps, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            at = lo + np.flatnonzero(score[lo:hi] >= (heap[0][0] if len(heap) == self.k else 1))
            if len(at) > self.k:
                at = at[np.lexsort((ids[at], ~known[at], -score[at]))[: self.k]]
            for s, i, there in zip(score[at].tolist(), ids[at].tolist(), known[at].tolist(), strict=True):
                row = (s, there, -i, i)
                if len(heap) < self.k:
                    heapq.heappush(heap, row)
                elif row > heap[0]:
                    heapq.heapreplace(heap, row)

    def batch(self) -> pa.RecordBatch:
        rows = [(i, r[3] if r[1] else None, r[0]) for i, heap in enumerate(self.heaps) for r in heap]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["_item", "doc_id", "score"])


def _slices_of(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes sum up to about ``most``, of a row at least."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(ends, most + (ends[at - 1] if at else 0), "right")))
        yield at, end
        at = end


def _candidates(index: DataFrame, block: Block, n_docs: int, n_terms: int, weights: np.ndarray, k: int) -> DataFrame:
    """(_item, doc_id, score): of each task's rows, the ``k`` best of each item."""
    sent = index.sparkSession.sparkContext.broadcast((block.starts, block.items, weights))
    n_items = len(block.ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, items, weight = sent.value
        best = Best(n_items, k)
        per_term = np.diff(starts)
        for b in batches:
            if not b.num_rows:
                continue
            known = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids = b.column(0).fill_null(0).to_numpy()
            m = np.array([BASE - LENGTH_SHARE + LENGTH_SHARE * n * n_docs // n_terms for n in b.column(1).to_pylist()], np.int64)  # Python's integers can't overflow
            held = b.column(2).value_lengths().to_numpy()
            term, tf = (b.column(j).flatten().to_numpy().astype(np.int64) for j in (2, 3))
            doc = np.repeat(np.arange(b.num_rows), held)
            impact = weight[term] * (SCALE * tf // (1000 * tf + K1 * m[doc]))
            edges = np.concatenate(([0], np.cumsum(held)))
            made = np.concatenate(([0], np.cumsum(per_term[term])))
            for lo, hi in _slices_of(np.diff(made[edges]), TRIPLES):
                own = slice(edges[lo], edges[hi])
                n = per_term[term[own]]
                before = np.cumsum(n) - n
                item = items[np.repeat(starts[term[own]] - before, n) + np.arange(n.sum())]
                at, of, score = summed(item, np.repeat(doc[own] - lo, n), np.repeat(impact[own], n), hi - lo)
                best.add(at, score, ids[lo + of], known[lo + of])
        yield best.batch()

    return index.mapInArrow(run, "_item int, doc_id long, score long")


def _weights(index: DataFrame, block: Block) -> tuple[int, int, np.ndarray]:
    """N, L and the weight of each of the block's terms."""
    n_docs, n_terms = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(block.numbers), np.int64)
    for r in index.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row per term of the block at most
        df[r["t"]] = r["count"]
    return n_docs, n_terms, np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def _ranked(docs: DataFrame, block: Block, names: tuple[str, str], kind: str, k: int) -> DataFrame:
    index = cut(_index(docs, block.numbers, *names))
    n_docs, n_terms, weights = _weights(index, block)
    order: list[Column] = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    spread = _candidates(index, block, n_docs, n_terms, weights, k).repartitionByRange("_item", *order)
    # Spark takes the first k of an item in each range before it gathers them, since only ranks up to k are asked for.
    best = spread.withColumn("rank", F.row_number().over(W.partitionBy("_item").orderBy(*order))).filter(F.col("rank") <= k)
    ids = docs.sparkSession.createDataFrame(list(enumerate(block.ids)), f"_item int, item_id {kind}")
    return best.join(F.broadcast(ids), "_item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, k: int = TOP, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item.  Ids of documents are integers."""
    kind = dict(items.dtypes)[item_col]
    parts = [_ranked(docs, b, (id_col, text_col), kind, k) for b in _blocks(items, item_col, item_text_col, max_pairs)]
    none = docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, parts) if parts else none


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), words AS (
  SELECT row, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), lengths AS (
  SELECT row, count(*) AS n FROM words GROUP BY row
), total AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths
), measure AS (
  SELECT row, 100 - 50 + ((50 * n * docs) // terms) AS m FROM lengths, total
), tf AS (
  SELECT row, doc_id, term, count(*) AS tf FROM words GROUP BY row, doc_id, term
), df AS (
  SELECT term, count(*) AS df FROM tf GROUP BY term
), weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, total
), items AS (
  SELECT row_number() OVER () AS item, item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM benchmark
), wanted AS (
  SELECT DISTINCT item, item_id, term FROM (SELECT item, item_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM items)
), scored AS (
  SELECT item, item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM wanted JOIN tf USING (term) JOIN weight USING (term) JOIN measure USING (row)
  GROUP BY item, item_id, row, doc_id
), ranked AS (
  SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id ASC NULLS LAST, row) AS INTEGER) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
