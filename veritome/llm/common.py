"""Pieces that several operators share: table access, lineage cuts, word patterns."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veritome.shipping import reach_workers

#: A word: a run without ASCII white space (space, \t \n \v \f \r).
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` says.

    Only a local session, whose machine is its cluster, gets a temporary folder where that is unset.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="veritome-"))
    return sc.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, whichever it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once, reliably, and forget how it was made."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def whole_texts(df: DataFrame) -> DataFrame:
    """``df``, about to be sent to Python, whose workers must find this package.

    Batches are as large as the session says (``veritome.shipping.settle``); what runs there takes them apart further.
    """
    reach_workers(df.sparkSession)
    return df


def running(df: DataFrame, order: Sequence[Column], *, few: bool = False, **sums: Column) -> DataFrame:
    """``df`` with, for each of ``sums``, the sum over all rows before in the global order.

    Rows are range-sorted; totals of the ranges, one row each, are summed up, and the sums are
    taken inside ranges.  No window spans a key, and a range is as large as a partition, so
    ``order`` should be total or its ties few.  A table counted as ``few`` is one range.
    """
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    if few:
        return df.withColumns({n: before(c, W.orderBy(*order)) for n, c in sums.items()})
    placed, offsets = _ranges(df, order, sums)
    out = placed.join(F.broadcast(offsets), "_part")
    return out.withColumns({n: F.col(f"_{n}") + before(c, W.partitionBy("_part").orderBy(*order)) for n, c in sums.items()}).drop("_part", *(f"_{n}" for n in sums))


def _ranges(df: DataFrame, order: Sequence[Column], sums: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Range-sorted rows with their range's number, and per range the sums over all ranges before."""
    placed = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = placed.groupBy("_part").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row per range
    return placed, totals.select("_part", *(F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums))


def crossing(df: DataFrame, order: Sequence[str], amount: str, limit: int) -> Row | None:
    """The last row, in the global order, before which less than ``limit`` is summed up, and what ``room`` it has left.

    Sums of the ranges say in which one that is; only its rows are summed up one by one.
    """
    placed, offsets = _ranges(df, [F.col(c) for c in order], {"sum": F.col(amount)})
    part = offsets.filter(F.col("_sum") < limit).orderBy(F.col("_part").desc()).first()
    if part is None:
        return None
    inside = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = placed.filter(F.col("_part") == part["_part"]).withColumn("room", limit - part["_sum"] - F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return rows.filter("room > 0").orderBy(*(F.col(c).desc() for c in order)).drop("_part").first()


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else.

    Pure ASCII strings take the JVM's fast path, which is the same mapping there.
    """
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only after counting; a larger side is joined by shuffle.  ``df`` should be cut."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def free_name(taken: Sequence[str], wanted: str) -> str:
    """``wanted``, or the first variant that clashes with no column in ``taken`` (Spark ignores case)."""
    low, name, i = {c.lower() for c in taken}, wanted, 0
    while name.lower() in low:
        i += 1
        name = f"{wanted}_{i}"
    return name


#: Bits of a filter per key, words of 64 bits per row, and the most words; at 16 million keys a filter begins to fill up.
BITS_PER_KEY, ROW_WORDS, MAX_WORDS = 16, 64, 1 << 22


class KeyFilter:
    """Which rows may have a key of a table, told without joining them: a bit array of the keys' hashes.

    Its size follows the number of keys, up to MAX_WORDS (32 MB, what may be broadcast); a
    fuller filter lets more rows pass as possible hits and loses none.  ``keys`` should be cut.
    """

    def __init__(self, keys: DataFrame, *names: str) -> None:
        wanted = max(1, keys.count() * BITS_PER_KEY // 64)
        self.words = min(MAX_WORDS, max(1 << 10, 1 << wanted.bit_length()))
        words = keys.select(*self._slot(names)).groupBy("_row", "_w").agg(F.bit_or(F.expr("shiftleft(1L, _b)")).alias("_bits"))
        filled = words.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("_w", "_bits"))).alias("_map"))
        every = F.sequence(F.lit(0), F.lit(ROW_WORDS - 1))
        self.bits = filled.select("_row", F.transform(every, lambda i: F.coalesce(F.try_element_at("_map", i), F.lit(0))).alias("_bits"))

    def _slot(self, names: Sequence[str]) -> list[Column]:
        h = F.pmod(F.xxhash64(*names), F.lit(self.words * 64))
        return [F.shiftright(h, 12).alias("_row"), F.shiftright(h, 6).bitwiseAND(F.lit(ROW_WORDS - 1)).cast("int").alias("_w"), h.bitwiseAND(F.lit(63)).cast("int").alias("_b")]

    def mark(self, rows: DataFrame, *names: str) -> DataFrame:
        """``rows`` with a boolean ``_hit``: false if the key is surely not in the table."""
        out = rows.select("*", *self._slot(names)).join(F.broadcast(self.bits), "_row", "left")
        return out.withColumn("_hit", F.coalesce(F.expr("getbit(_bits[_w], _b) = 1"), F.lit(False))).drop("_row", "_w", "_b", "_bits")


def packed(docs: DataFrame) -> Column:
    """All columns of ``docs`` in one struct, so that no name of theirs can clash with a helper's; ``row.*`` gives them back."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")


def apply_decisions(docs: DataFrame, id_col: str, text_col: str, cheap: Callable[[Column], Column], full: Callable[[Column], Column] | None, decisions: DataFrame, *, max_broadcast: int = 100_000) -> DataFrame:
    """``docs`` without the rows that ``decisions`` removes, all columns kept.

    ``decisions`` (_gid, _gcheap, _gkey, _group, _tie) name rows by id and by two keys of their
    text, of which ``full`` is worked out only where ``cheap`` says that a row may be named;
    without ``full`` the cheap one decides.  Rows named with _tie false go, and of those with
    _tie true one per (id, _group) stays.

    Decisions up to ``max_broadcast`` are broadcast, and ``docs`` is read once.  Beyond, rows that
    a filter of the keys doesn't hold go straight through and only the others are joined.
    """
    told = cut(decisions.groupBy("_gid", "_gcheap", "_gkey").agg(F.max("_tie").alias("_tie"), F.max("_group").alias("_group")))
    n, ties = told.agg(F.count(F.lit(1)), F.count_if("_tie")).first()
    text = F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit(""))
    rows = docs.select(packed(docs), docs[id_col].alias("_id")).withColumn("_cheap", cheap(text))
    rows = KeyFilter(told, "_gcheap").mark(rows, "_cheap").withColumn("_key", F.when(F.col("_hit"), full(text) if full else F.col("_cheap")))
    same = F.col("_id").eqNullSafe(F.col("_gid")) & (F.col("_cheap") == F.col("_gcheap")) & (F.col("_key") == F.col("_gkey"))
    if n <= max_broadcast:
        joined = rows.join(F.broadcast(told), same, "left")
        out = joined.filter("_tie is null").select("row")
    else:
        joined = rows.filter("_hit").join(told, same, "left")
        out = rows.filter("not _hit").select("row").unionByName(joined.filter("_tie is null").select("row"))
    if ties:
        out = out.unionByName(joined.filter("_tie").groupBy("_id", "_group").agg(F.first("row").alias("row")).select("row"))
    return out.select("row.*")
