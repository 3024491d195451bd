"""SimHash near-deduplication with exact tiled comparison.

Fingerprints are 64-bit majorities over XXH64 hashes of 3-word shingles.  Two fingerprints
within ``RADIUS`` = 2 bits differ in at most two of eight bytes, so they agree on the six
other bytes for at least one of 28 choices: distinct fingerprints are dealt out by these
48-bit keys.  A key leaves 16 bits free, so no group can hold more than 65,536 distinct
fingerprints, however many documents are alike, and no link is lost.  Groups, sorted by population count,
are packed into tiles, which numpy compares by exclusive-or and bit counts; tile pairs whose
counts differ beyond the radius are skipped.  Groups emit the links of a spanning forest,
never all pairs.

Links are joined into components by alternating large-star and small-star rounds on
distributed tables, cut by reliable checkpoints.

Defined results: null and empty texts have fingerprint zero and are linked like any other;
with fewer than three words the whole sequence is the one shingle; repeated rows are copies;
a null id is never the smallest unless all ids of a component are null; an empty table gives
an empty result; other columns are ignored, whatever their names; of a very long text 65,536
shingles at a time are summed up.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritome.llm.bpe import slices
from veritome.llm.common import apply_decisions, cut, table, whole_texts

RADIUS = 2
SEED = 42
#: Bytes of a fingerprint left out of a key; RADIUS of eight.
CHOICES = list(combinations(range(8), RADIUS))
MASKS = [~sum(0xFF << 8 * b for b in c) & (1 << 64) - 1 for c in CHOICES]
TILE = 256


def fingerprint(text: str | None) -> int:
    """Unsigned fingerprint; bytes.lower and bytes.split know ASCII only, as the words are defined."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = map(b" ".join, zip(words, words[1:], words[2:], strict=False)) if len(words) >= 3 else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in joined), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = 0
        for keys, texts in slices(iter([pa.RecordBatch.from_arrays([b.column(0), b.column(2)], ["_id", "_text"])])):
            fp = np.fromiter(map(fingerprint, texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([keys, b.column(1).slice(at, len(texts)), pa.array(fp.view(np.int64))], ["_id", "_text_hash", "_fp"])
            at += len(texts)


class Tally:
    """Tile pairs compared, and tile pairs of one group skipped by their population counts."""

    def __init__(self) -> None:
        self.compared = self.skipped = 0


def forest(group: np.ndarray, fps: np.ndarray, tile: int = TILE, tally: Tally | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, its root) of a spanning forest among fingerprints (uint64) of the same group within RADIUS.

    ``group`` is sorted.  Rows are sorted by group and population count and cut into tiles, which
    may hold many groups or a part of one; two tiles meet only if a group runs from one into the
    other and its counts there are within RADIUS.
    """
    pop = np.bitwise_count(fps).astype(np.int16)
    order = np.lexsort((pop, group))
    g, f, pop = group[order], fps[order], pop[order]
    root = np.arange(len(f))

    def find(x: np.ndarray) -> np.ndarray:
        while not np.array_equal(up := root[x], x):
            x = up
        return x

    tally = tally or Tally()
    starts = range(0, len(f), tile)
    for i in starts:
        last = min(i + tile, len(f)) - 1
        for j in range(i, len(f), tile):
            if j > i and g[j] != g[last]:
                break
            if j > i and pop[j] - pop[last] > RADIUS:
                tally.skipped += len(range(j, int(np.searchsorted(g, g[last], "right")), tile))
                break
            tally.compared += 1
            x, y = np.nonzero((np.bitwise_count(f[i : last + 1, None] ^ f[None, j : j + tile]) <= RADIUS) & (g[i : last + 1, None] == g[None, j : j + tile]))
            x, y = x + i, y + j
            while len(x):
                x, y = find(x), find(y)
                apart = x != y
                x, y = x[apart], y[apart]
                np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
    root = find(np.arange(len(f)))
    linked = np.flatnonzero(root != np.arange(len(f)))
    return f[linked], f[root[linked]]


def _group_links(choice: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among whole groups: rows sorted so that equal (choice, key) are neighbours; rows alone in theirs have none."""
    key = fps & np.array(MASKS, np.uint64)[choice]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (choice[1:] != choice[:-1])))
    alone = new & np.concatenate((new[1:], [True]))
    return forest(np.cumsum(new)[~alone], fps[~alone])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of sorted rows (choice, fp); a group that runs on into the next batch waits for it."""
    held_c, held_f = np.empty(0, np.int64), np.empty(0, np.uint64)
    masks = np.array(MASKS, np.uint64)

    def out(c: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(f):
            a, b = (x.view(np.int64) for x in _group_links(c, f))
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["big", "small"])

    for b in batches:
        c = np.r_[held_c, b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)]
        f = np.r_[held_f, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
        if not len(f):
            continue
        key = f & masks[c]
        last = np.flatnonzero((key != key[-1]) | (c != c[-1]))
        at = last[-1] + 1 if len(last) else 0
        yield from out(c[:at], f[:at])
        held_c, held_f = c[at:], f[at:]
    yield from out(held_c, held_f)


def _with_least(links: DataFrame, node: str, neighbours: DataFrame) -> DataFrame:
    """``links`` with ``m``, the smallest of node ``node`` and its ``neighbours`` (big: the node, small: a neighbour).

    Joined on a recomputed key, so that both sides are dealt out anew and a hot node's links can be split.
    """
    least = neighbours.groupBy("big").agg(F.min("small").alias("m")).select(F.bitwise_not("big").alias("_key"), F.least("big", "m").alias("m"))
    return links.withColumn("_key", F.bitwise_not(node)).join(least, "_key").drop("_key")


def components(links: DataFrame) -> DataFrame:
    """(big, small) rows of stars: every linked node but the root with its component's smallest node.

    ``links`` are distinct (big, small) with big > small.  Each round is a large-star and a
    small-star step; the rounds end when the links no longer change.
    """
    stars = cut(links)
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("big", "small").cast("decimal(20,0)"))).first())
    before = mark(stars)
    while before[0]:
        both = stars.unionByName(stars.select(F.col("small").alias("big"), F.col("big").alias("small")))
        large = cut(_with_least(stars, "small", both).select("big", F.col("m").alias("small")).distinct())
        near = _with_least(large, "big", large)
        moved = near.filter("small <> m").select(F.col("small").alias("big"), F.col("m").alias("small"))
        stars = cut(near.select("big", F.col("m").alias("small")).unionByName(moved).distinct())
        after = mark(stars)
        if after == before:
            break
        before = after
    return stars


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, text_hash, fp (signed), component_id, root (a fingerprint of the component)."""
    text = docs[text_col].cast("string")
    schema = docs.select(docs[id_col].alias("_id"), F.lit(0).cast("long").alias("_text_hash"), F.lit(0).cast("long").alias("_fp")).schema
    texts = docs.select(docs[id_col].alias("_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_text_hash"), text.alias("_text"))
    rows = cut(whole_texts(texts).mapInArrow(_fingerprints, schema))
    unique = cut(rows.groupBy("_fp").agg(F.min("_id").alias("_least")))
    signed = [m - (1 << 64) if m >> 63 else m for m in MASKS]
    keys = unique.select("_fp", F.posexplode(F.array(*[F.col("_fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("choice", "key"))
    dealt = keys.repartition("choice", "key").sortWithinPartitions("choice", "key").select("choice", "_fp")
    links = dealt.mapInArrow(_links, "big long, small long").distinct()
    stars = components(links)
    nodes = stars.select(F.col("big").alias("_fp"), F.col("small").alias("root")).unionByName(stars.select(F.col("small").alias("_fp"), F.col("small").alias("root")).distinct())
    linked = cut(nodes.join(unique, "_fp"))
    smallest = linked.groupBy("root").agg(F.min("_least").alias("component_id"))
    of_fp = unique.join(linked.select("_fp", "root").join(smallest, "root"), "_fp", "left").select(
        "_fp", F.coalesce("root", "_fp").alias("root"), F.when(F.col("root").isNull(), F.col("_least")).otherwise(F.col("component_id")).alias("component_id")
    )
    # Joined on a recomputed key, both sides are dealt out anew, so that adaptive execution can split a hot fingerprint's rows.
    again = F.bitwise_not("_fp")
    both = rows.withColumn("_key", again).join(of_fp.select(again.alias("_key"), "root", "component_id"), "_key")
    return both.select(F.col("_id").alias(id_col), F.col("_text_hash").alias("text_hash"), F.col("_fp").alias("fp"), "component_id", "root")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id; all columns kept."""
    found = cut(near_duplicates(docs, id_col, text_col).select(F.col(id_col).alias("_gid"), F.col("text_hash").alias("_gkey"), F.col("root").alias("_group"), F.col(id_col).eqNullSafe(F.col("component_id")).alias("_tie")))
    repeated = found.filter("_tie").groupBy("_group").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_group")
    decisions = found.filter("not _tie").unionByName(found.filter("_tie").join(repeated, "_group", "left_semi").select(found.columns))
    return apply_decisions(docs, id_col, text_col, F.xxhash64, None, decisions.withColumn("_gcheap", F.col("_gkey")))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
