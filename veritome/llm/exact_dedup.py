"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Level 1 counts rows per byte length, level 2 counts rows per (length, hash of the first
characters), and only rows of groups that survive both get the SHA-256 of their whole text.
Survivors are remembered in a bit filter whose size follows their number, so
the text never leaves its partition: what is shuffled is counts, ids and digests.  A false
positive of the filter costs one hash and changes nothing, since groups are formed on the
full digest.  Hot groups are pre-aggregated map-side, and the join that hands a group's
result to its rows carries ids only and can be split by adaptive execution.

Defined results: null text counts as empty; texts are equal when identical after
lower-casing A-Z only; of equal texts the row with the largest id stays, a null id being
smallest, and among rows that repeat an id one stays; an empty table gives an empty result;
other columns of the input are ignored, whatever their names; a very long text is hashed as
it stands, in its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritome.llm.common import KeyFilter, apply_decisions, ascii_lower, broadcast_if_small, cut, table

#: Groups of copies up to this number are broadcast to their rows; more are joined by shuffle.
MAX_BROADCAST_GROUPS = 50_000
PREFIX_CHARS = 256


def _cheap(text: Column, prefix_chars: int) -> Column:
    """Levels 1 and 2 as one key: byte length and hash of the first characters."""
    return F.xxhash64(F.octet_length(text), ascii_lower(F.substring(text, 1, prefix_chars)))


def _full(text: Column) -> Column:
    return F.lower(F.sha2(ascii_lower(text), 256))


def _refined(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int, digest_all: bool) -> DataFrame:
    """(_id, _prefix, _sha, keep_id, group_size, kept) of every row; the last three are null for rows without a copy."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].alias("_id"), text.alias("_t")).withColumns({"_len": F.octet_length("_t"), "_prefix": _cheap(F.col("_t"), prefix_chars)})
    small = cut(rows.select("_len", "_prefix"))
    repeated = lambda df, key: cut(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key))
    level1 = KeyFilter(repeated(small, "_len"), "_len").mark(small, "_len").filter("_hit")
    level2 = KeyFilter(repeated(level1, "_prefix"), "_prefix").mark(rows, "_prefix")
    full = F.unhex(_full(F.col("_t")))
    digest = full if digest_all else F.when(F.col("_hit"), full)
    hashed = cut(level2.select("_id", "_prefix", "_hit", digest.alias("_sha"), F.monotonically_increasing_id().alias("_row")))
    groups = (
        hashed.filter("_hit")
        .groupBy("_sha")
        .agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.max_by("_row", F.struct(F.col("_id").isNotNull(), "_id", "_row")).alias("_keep_row"))
        .filter("group_size > 1")
    )
    # A recomputed key makes a shuffled join deal out both sides anew, so that a hot group can be split.
    groups = broadcast_if_small(cut(groups.withColumn("_sha", F.unhex(F.hex("_sha")))), MAX_BROADCAST_GROUPS)
    return hashed.join(groups, "_sha", "left").withColumn("kept", F.col("_row") == F.col("_keep_row"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, prefix_chars: int = PREFIX_CHARS, digest_all: bool = False) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest.

    ``digest`` is the SHA-256 of the normalised text; without ``digest_all`` it is null for
    rows whose length and prefix already prove them unique.
    """
    alone = F.col("group_size").isNull()
    return _refined(docs, id_col, text_col, prefix_chars, digest_all).select(
        F.col("_id").alias(id_col),
        F.when(alone, F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce("kept", F.lit(True)).alias("kept"),
        F.lower(F.hex("_sha")).alias("digest"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept.

    Digests are worked out for rows that share length and prefix with another, and again only
    for rows that share them with one to be removed; no other row's text is read to its end.
    """
    gone = _refined(docs, id_col, text_col, prefix_chars, False).filter("not kept")
    sha = F.lower(F.hex("_sha"))
    decisions = gone.select(F.col("_id").alias("_gid"), F.col("_prefix").alias("_gcheap"), sha.alias("_gkey"), sha.alias("_group"), F.col("_id").eqNullSafe(F.col("keep_id")).alias("_tie"))
    return apply_decisions(docs, id_col, text_col, lambda t: _cheap(t, prefix_chars), _full, decisions)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)
    return out.withColumnRenamed("digest", "text_sha256")


ORACLE = """
WITH n AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, n.text_sha256
FROM n JOIN g USING (text_sha256)
"""
