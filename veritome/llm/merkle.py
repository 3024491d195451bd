"""Merkle manifest of a table: a digest per row, trees per source, a root, and each row's proof.

Leaves are digests of whole rows, worked out natively where the rows lie; from then on only ids,
sources and digests move.  Rows are range-sorted by (source, id, leaf); counts per range and
source turn places in a range into places in a source, so that no window or task holds a
source.  A tree of arity ``ARITY`` is cut into aligned blocks of ``ARITY ** HEIGHT`` consecutive
nodes, whose subtrees no other block touches.  Each block is traversed recursively in postorder: a
subtree returns its digest, and while the recursion unwinds the siblings of each subtree are
appended to the leaves it contains.  The blocks' roots are the nodes of the next traversal, dealt out in the
same way, until every source has one root; the sources' roots are one more tree.  A node's path
is its siblings in its block and then the path of its block, and is handed down block by
block, once for each block, not for each row.

Defined results: a null id is the smallest of its source and is never tampered with; rows that repeat
an id are ordered by their leaves, and rows equal in all five columns may change places, which changes neither
digest nor root and of their proofs only which row has which; null columns are ``-``, an empty text
is ``0:``; the null source is a source of its own, before all others; an empty table gives an
empty result; other columns are ignored, whatever their names; a very long text is hashed as it
stands, in its row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veritome.llm.common import broadcast_if_small, cut, table
from veritome.shipping import reach_workers

#: Children of a node; levels that a block spans; places (range, tree) up to which their offsets are broadcast.
ARITY, HEIGHT, MAX_OFFSETS = 3, 7, 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODES = "tree string, at long, digest string, size long"


def digest_of(columns: list[Column]) -> Column:
    """Lower-case hex SHA-256 of values, each with its UTF-8 byte count, null as ``-``."""
    said = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in said)), 256)


def placed(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """``rows`` with ``at``, the place in the row's tree from 0, and ``size``, the tree's number of rows; cut."""
    sort = [F.col(tree), *(F.col(c).asc_nulls_first() for c in order)]
    ranges = cut(rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_seen", F.monotonically_increasing_id()))
    ranges = ranges.withColumn("_range", F.shiftright("_seen", 33))
    counts = ranges.groupBy("_range", tree).agg(F.count(F.lit(1)).alias("_n"), F.min("_seen").alias("_first"))
    earlier = W.partitionBy(tree).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row per range
    base = F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")
    offsets = cut(counts.select("_range", tree, base.alias("_base"), F.sum("_n").over(W.partitionBy(tree)).alias("size")))
    out = ranges.join(broadcast_if_small(offsets, MAX_OFFSETS), ["_range", tree])
    return out.withColumn("at", F.col("_seen") + F.col("_base")).drop("_seen", "_range", "_base", "_n")


def _block() -> Column:
    return F.expr(f"at div {ARITY**HEIGHT}").alias("block")


def climb(digests: list[str], levels: int, arity: int = ARITY) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root of the subtree of ``levels`` levels over ``digests``, and for each of these its siblings to the left and right, level by level."""
    paths: list[list[tuple[str, str]]] = [[] for _ in digests]

    def subtree(lo: int, level: int) -> str:
        if level == 0:
            return digests[lo]
        span = arity ** (level - 1)
        starts = range(lo, min(lo + arity * span, len(digests)), span)
        children = [subtree(s, level - 1) for s in starts]
        for i, s in enumerate(starts):
            siblings = "".join(children[:i]), "".join(children[i + 1 :])
            for leaf in range(s, min(s + span, len(digests))):
                paths[leaf].append(siblings)
        return sha256("".join(children).encode()).hexdigest()

    return subtree(0, levels), paths


def levels_of(size: int, arity: int = ARITY, height: int = HEIGHT) -> int:
    """Levels that a block spans in a tree of ``size`` nodes: a whole block's, or as many as the tree has."""
    n = 0
    while n < height and arity**n < size:
        n += 1
    return n


def fold(digest: str, path: Iterator[tuple[str, str]]) -> str:
    """The root that ``digest`` has with these siblings."""
    for left, right in path:
        digest = sha256((left + digest + right).encode()).hexdigest()
    return digest


def _by_block(nodes: DataFrame, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    return nodes.groupBy("tree", _block()).applyInArrow(work, schema)


def _roots(nodes: DataFrame) -> DataFrame:
    """The roots of blocks, as nodes of the next traversal."""

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("at")
        at, size = block["at"][0].as_py(), block["size"][0].as_py()
        root, _ = climb(block["digest"].to_pylist(), levels_of(size))
        span = ARITY**HEIGHT
        return pa.table({"tree": [block["tree"][0].as_py()], "at": [at // span], "digest": [root], "size": [-(-size // span)]}, pa.schema([("tree", pa.string()), ("at", pa.int64()), ("digest", pa.string()), ("size", pa.int64())]))

    return _by_block(nodes.select("tree", "at", "digest", "size"), run, _NODES)


_PATH = pa.list_(pa.string())
_PATHS = "tree string, at long, left array<string>, right array<string>, subroot string, root string"
Finish = Callable[[pa.Table, list[list[tuple[str, str]]], str, str], pa.Table]


def _with_paths(nodes: DataFrame, above: DataFrame, own: list[str], schema: str, finish: Finish) -> DataFrame:
    """What ``finish`` makes of each block of ``nodes``, its nodes' whole paths, the subroot and the root; ``above`` has them for each block."""

    def run(block: pa.Table, parent: pa.Table) -> pa.Table:
        block = block.sort_by("at")
        _, paths = climb(block["digest"].to_pylist(), levels_of(block["size"][0].as_py()))
        left, right, subroot, root = (parent[c][0].as_py() for c in ("left", "right", "subroot", "root"))
        rest = [*zip(left, right, strict=True)]
        return finish(block, [[*p, *rest] for p in paths], subroot, root)

    blocks = nodes.select("tree", "at", "digest", "size", *own).groupBy("tree", _block())
    parents = above.select("tree", F.col("at").alias("block"), "left", "right", "subroot", "root").groupBy("tree", "block")
    return blocks.cogroup(parents).applyInArrow(run, schema)


def _paths(block: pa.Table, paths: list[list[tuple[str, str]]], subroot: str, root: str) -> pa.Table:
    sides = [pa.array([[s[i] for s in p] for p in paths], _PATH) for i in (0, 1)]
    same = [pa.array([x] * block.num_rows, pa.string()) for x in (subroot, root)]
    return pa.table([block["tree"], block["at"], *sides, *same], ["tree", "at", "left", "right", "subroot", "root"])


def _ascend(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Nodes of each traversal from ``nodes`` up, and the trees' roots."""
    rounds = [nodes]
    while (rounds[-1].agg(F.max("size")).first()[0] or 0) > 1:
        rounds.append(cut(_roots(rounds[-1])))
    return rounds[:-1], rounds[-1]


def _descend(rounds: list[DataFrame], top: DataFrame) -> DataFrame:
    """Paths of the nodes of the first of ``rounds``; ``top`` has the paths of the trees' roots."""
    for nodes in reversed(rounds):
        top = cut(_with_paths(nodes, top, [], _PATHS, _paths))
    return top


def _proofs(block: pa.Table, paths: list[list[tuple[str, str]]], subroot: str, root: str) -> pa.Table:
    leaf, other = block["digest"].to_pylist(), block["other"].to_pylist()
    proof = [sha256("".join(left + right for left, right in p).encode()).hexdigest() for p in paths]
    folded = [fold(o or d, p) for o, d, p in zip(other, leaf, paths, strict=True)]
    made = {"leaf": leaf, "subroot": [subroot] * len(leaf), "root": [root] * len(leaf), "proof_sha256": proof, "folded_root": folded}
    return pa.table([block["id"], *(pa.array(v, pa.string()) for v in made.values())], ["id", *made])


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, *, tampered: tuple[Column, Column] | None = None) -> DataFrame:
    """One row per row: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``fields`` are the columns that a leaf covers: the id, the source, others, and the text.  ``tampered``
    says which rows' texts are taken as changed, and into what, when proofs are folded.
    """
    reach_workers(docs.sparkSession)
    changed, text = tampered or (F.lit(False), F.lit(None))
    whole = docs.select(*(docs[f"`{c}`"].alias(f"_{i}") for i, c in enumerate(fields)), changed.alias("_changed"), text.cast("string").alias("_other"))
    values = [F.col(f"_{i}") for i in range(len(fields))]
    tree = F.coalesce(F.concat(F.lit("="), values[1].cast("string")), F.lit("-"))  # "-" sorts before "="
    other = F.when(F.col("_changed"), digest_of([*values[:-1], F.col("_other")]))
    leaves = placed(whole.select(values[0].alias("id"), tree.alias("tree"), digest_of(values).alias("digest"), other.alias("other")), "tree", "id", "digest")

    rounds, subroots = _ascend(leaves)
    sources = placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest"), "tree", "source")
    source_rounds, roots = _ascend(sources)
    none = F.array().cast("array<string>")
    top = roots.select("tree", "at", none.alias("left"), none.alias("right"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    of_sources = _descend(source_rounds, top).drop("tree", "subroot").join(sources, "at")
    of_sources = cut(of_sources.select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("at"), "left", "right", F.col("digest").alias("subroot"), "root"))

    kind = leaves.schema["id"].dataType.simpleString()
    schema = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    out = _with_paths(leaves, _descend(rounds[1:], of_sources), ["id", "other"], schema, _proofs)
    return out.withColumnRenamed("id", fields[0]).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    changed = F.crc32(F.encode(docs["doc_id"].cast("string"), "UTF-8")) % 2 == 0
    return manifest(docs, tampered=(changed, F.replace(docs["text"], F.lit("\n"), F.lit(""))))


ORACLE = r"""
WITH RECURSIVE said AS (
  SELECT row_number() OVER () AS row, doc_id, text, coalesce('=' || source, '-') AS tree,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
    list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda a, x: list_reduce(list_prepend(xor(a, x), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
        lambda r, i: CASE WHEN (r & 1) = 1 THEN xor(r >> 1, CAST(3988292384 AS BIGINT)) ELSE r >> 1 END)) AS crc
  FROM documents
), leaves AS (
  SELECT row, doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN (crc & 1) = 1 THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS other
  FROM said
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves
), nodes AS (
  SELECT tree, 0 AS lvl, place AS pos, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM placed
  UNION ALL
  SELECT tree, lvl + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM nodes WHERE n > 1 GROUP BY tree, lvl, pos // 3, n
), subroots AS (
  SELECT tree, lvl AS height, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS lvl, place AS pos, subroot AS digest, n FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM tops WHERE n > 1 GROUP BY lvl, pos // 3, n
), own AS (
  SELECT p.row, x.tree, x.lvl, x.pos FROM placed p JOIN nodes x ON x.tree = p.tree AND x.n > 1 AND x.pos = p.place // CAST(pow(3, x.lvl) AS BIGINT)
), steps AS (
  SELECT o.row, o.lvl AS step, coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (s.pos < o.pos), '') AS l, coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (s.pos > o.pos), '') AS r
  FROM own o JOIN nodes s ON s.tree = o.tree AND s.lvl = o.lvl AND s.pos // 3 = o.pos // 3 GROUP BY o.row, o.lvl
  UNION ALL
  SELECT p.row, u.height + x.lvl, coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (s.pos < x.pos), ''), coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (s.pos > x.pos), '')
  FROM placed p JOIN subroots u USING (tree) JOIN tops x ON x.n > 1 AND x.pos = u.place // CAST(pow(3, x.lvl) AS BIGINT) JOIN tops s ON s.lvl = x.lvl AND s.pos // 3 = x.pos // 3
  GROUP BY p.row, u.height, x.lvl, x.pos
), folded AS (
  SELECT row, 0 AS step, coalesce(other, leaf) AS digest FROM placed
  UNION ALL
  SELECT f.row, f.step + 1, sha256(s.l || f.digest || s.r) FROM folded f JOIN steps s ON s.row = f.row AND s.step = f.step
), last AS (
  SELECT row, arg_max(digest, step) AS folded_root FROM folded GROUP BY row
), proofs AS (
  SELECT row, sha256(string_agg(l || r, '' ORDER BY step)) AS proof_sha256 FROM steps GROUP BY row
), top AS (
  SELECT digest AS root FROM tops WHERE n = 1
)
SELECT p.doc_id, p.leaf, u.subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed p JOIN subroots u USING (tree) JOIN last USING (row) LEFT JOIN proofs USING (row), top
"""
