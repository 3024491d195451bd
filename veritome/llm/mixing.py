"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in an order shuffled by a keyed hash, repeated
``max_epochs`` times; a packet is up to ``PACKET`` words of one document in one epoch, so that a
very long document doesn't hold up its source.  Its virtual finish time is the number of words of
its source up to and including it, over the target of its source; a document's is that of its last
packet.  All packets are range-sorted by virtual finish time, words are summed up in that global
order, and the mix is truncated where they reach the total budget: packets before that place are
taken whole, the one that crosses it gives its first words, later ones give none.  A source so
misses its target by about a packet, the one in service when the budget ends.

A source may hold most rows, so no window spans a source: every order here, of documents within
sources, of packets, and of sources, is a range sort whose ranges are summed up one by one
(``common.running``).

Defined results: null text has size 0; a null source is a source of its own, ordered last;
a source without words has target 0 and no finish time; documents without words take no place in
the order; rows with equal source, id and size are interchangeable; a very long text is many
packets; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritome.llm.common import WORD, broadcast_if_small, crossing, cut, packed, running, table

#: A source table up to this many rows is broadcast; a larger one is joined by shuffle.
MAX_BROADCAST_SOURCES = 20_000


def water_fill(sources: DataFrame, weights: Sequence[int], budget_num: int, budget_den: int, max_epochs: int) -> DataFrame:
    """(skey, source_size, target, offset): sources share budget_num/budget_den of all words by weight.

    Weights repeat over the sources in code point order, null last.  A target stops at
    ``max_epochs`` times the size and the excess is shared again by weight: the sources
    that stop are the first by cap over weight, so running sums in that order find the level.
    All is exact integer arithmetic up to one division.  ``offset`` counts the words of the
    sources before in the order of ``skey``, in which a null source is the first.
    """
    n, words, nulls = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum("source_size"), F.lit(0)), F.count_if(F.col("skey") == "")).first()
    few = n <= MAX_BROADCAST_SOURCES
    rank = F.when(F.col("skey") == "", n - 1).otherwise(F.col("nth") - nulls)
    pick = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("source_rank"), F.lit(len(weights))).cast("int") + 1)
    ranked = running(sources, [F.col("skey")], few=few, nth=F.lit(1), offset=F.col("source_size")).withColumn("source_rank", rank).withColumn("w", pick.cast("long"))
    ranked = ranked.withColumn("cap", F.col("source_size") * max_epochs)
    ranked = cut(running(ranked, [F.col("cap") / F.col("w"), F.col("source_rank")], few=few, cap_before=F.col("cap"), w_before=F.col("w")))
    weight = ranked.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    onward, left = F.lit(weight) - F.col("w_before"), F.lit(words * budget_num) - F.col("cap_before") * budget_den
    is_open = F.col("cap") * onward * budget_den > F.col("w") * left
    level = ranked.filter(is_open).agg(F.min(F.struct(F.col("cap") / F.col("w"), "source_rank", left.alias("left"), onward.alias("onward"))).alias("at")).first()["at"]
    share = (F.col("w") * F.lit(level["left"])).cast("double") / F.lit(level["onward"] * budget_den) if level else F.lit(None).cast("double")
    return ranked.select("skey", "source_size", F.when(is_open, share).otherwise(F.col("cap").cast("double")).alias("target"), "offset")


#: Most words of a packet.
PACKET = 256


def _finish(words: Column, epoch: Column | int) -> Column:
    """Virtual time at which so many words of a document are served in an epoch; null without a target."""
    return F.try_divide((F.col("start") + words + F.col("source_size") * epoch).cast("double"), F.col("target"))


def _packet(k: Column, epoch: Column | int) -> tuple[Column, Column]:
    """A document's k-th packet in an epoch: its place in the global order, and its words."""
    before, done = k * PACKET, F.least(F.col("size"), (k + 1) * PACKET)
    epoch_ = F.lit(epoch) if isinstance(epoch, int) else epoch
    return F.struct(_finish(done, epoch).alias("finish"), F.col("skey").alias("skey"), epoch_.alias("epoch"), (F.col("start") + before).alias("at")), done - before


def _served(cut_at, epoch: int) -> Column:
    """Words that the mix takes of a document in an epoch; ``cut_at`` is the packet in which the budget ends."""
    if cut_at is None:
        return F.lit(0).cast("long")
    end = F.struct(F.lit(cut_at["finish"]).alias("finish"), F.lit(cut_at["skey"]).alias("skey"), F.lit(cut_at["epoch"]).alias("epoch"), F.lit(cut_at["at"]).cast("long").alias("at"))

    def words(k: Column) -> Column:
        place, whole = _packet(k, epoch)
        return F.when(place < end, whole).when(place == end, F.least(whole, F.lit(cut_at["room"]).cast("long"))).otherwise(0).cast("long")

    last = F.floor((F.col("size") - 1) / PACKET)
    crossed = F.aggregate(F.sequence(F.lit(0).cast("long"), last), F.lit(0).cast("long"), lambda a, k: a + words(k))
    idle = (F.col("size") == 0) | (F.coalesce(F.col("target"), F.lit(0.0)) == 0)
    return F.when(idle | (_packet(F.lit(0), epoch)[0] > end), 0).when(_packet(last, epoch)[0] < end, F.col("size")).otherwise(crossed).cast("long")


def _queues(docs: DataFrame, id_col: str, source_col: str, text_col: str, weights: Sequence[int], budget: tuple[int, int], max_epochs: int, seed: str):
    """Rows (_id, skey, size, source_size, target, start, turn), and the packet in which the budget ends (None without words)."""
    sized = cut(
        docs.select(
            docs[id_col].alias("_id"),
            _source_key(docs, source_col).alias("skey"),
            F.coalesce(F.regexp_count(docs[text_col], F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            _turn(docs, id_col, seed).alias("turn"),
            F.monotonically_increasing_id().alias("nth"),
        )
    )
    by_source = cut(sized.groupBy("skey").agg(F.sum("size").alias("source_size")))
    sources = broadcast_if_small(cut(water_fill(by_source, weights, *budget, max_epochs)), MAX_BROADCAST_SOURCES)
    # The number of the row makes the order total: repeats of a row may stand in many ranges.
    ordered = running(sized, [F.col(c) for c in ("skey", "turn", "_id", "size", "nth")], before=F.col("size"))
    rows = cut(ordered.join(sources, "skey").select("_id", "skey", "size", "source_size", "target", (F.col("before") - F.col("offset")).alias("start"), "turn"))
    words = by_source.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    total = min(words * budget[0] // budget[1], words * max_epochs)
    epochs = F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("epoch")
    packets = rows.filter("size > 0 and target > 0").select("skey", "size", "source_size", "target", "start", epochs)
    packets = packets.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / PACKET))).alias("k"))
    place, size = _packet(F.col("k"), F.col("epoch"))
    packets = packets.select(place.alias("place"), size.alias("words")).select("place.*", "words")
    last = crossing(packets, ("finish", "skey", "epoch", "at"), "words", total)
    return rows, last


def _source_key(docs: DataFrame, source_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), docs[source_col].cast("string")), F.lit(""))


def _turn(docs: DataFrame, id_col: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(docs[id_col].cast("string"), F.lit(""))))


WEIGHTS, BUDGET, MAX_EPOCHS, SEED = (3, 1, 2), (3, 2), 2, "mix"


def fair_mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", *, weights: Sequence[int] = WEIGHTS, budget: tuple[int, int] = BUDGET, max_epochs: int = MAX_EPOCHS, seed: str = SEED
) -> DataFrame:
    """One row per document: id, skey, size, source_size, target, start, virtual_finish, taken, turn.

    ``taken`` counts the words that the mix takes over all epochs; ``start`` is the number of
    words before the document in its source's queue; ``virtual_finish`` is that of its first epoch.
    """
    rows, last = _queues(docs, id_col, source_col, text_col, weights, budget, max_epochs, seed)
    served = [_served(last, e) for e in range(max_epochs)]
    return rows.select(F.col("_id").alias(id_col), "skey", "size", "source_size", "target", "start", _finish(F.col("size"), 0).alias("virtual_finish"), sum(served[1:], served[0]).alias("taken"), "turn")


def mix_documents(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", *, weights: Sequence[int] = WEIGHTS, budget: tuple[int, int] = BUDGET, max_epochs: int = MAX_EPOCHS, seed: str = SEED, whole: bool = False
) -> DataFrame:
    """``docs`` as mixed: a row per epoch in which a document is served, all columns kept, in no order.

    The document in which the budget ends gives its first words, or all of them if ``whole``.
    Since packets of a source and epoch are served in queue order, the global cut is reduced to
    the last document served of each; every row compares its own place with its source's, so
    texts are never shuffled.  Rows that repeat such a last document's id and size are taken like
    it.  For the order of service, join ``fair_mix``'s virtual finish times.
    """
    rows, last = _queues(docs, id_col, source_col, text_col, weights, budget, max_epochs, seed)
    ends = []
    for e in range(max_epochs):
        words = _served(last, e)
        ends.append(F.max(F.when(words > 0, F.struct("turn", F.col("_id").alias("id"), "size", words.alias("words")))).alias(f"end{e}"))
    ends_of = cut(rows.groupBy("skey").agg(*ends).select("skey", F.array(*[f"end{e}" for e in range(max_epochs)]).alias("ends")))
    keyed = docs.select(packed(docs), docs[id_col].alias("id"), docs[text_col].alias("text"), _source_key(docs, source_col).alias("skey"), _turn(docs, id_col, seed).alias("turn"))
    copies = keyed.join(broadcast_if_small(ends_of, MAX_BROADCAST_SOURCES), "skey").select("row", "id", "text", "turn", F.explode("ends").alias("end"))
    at, stop = F.struct("turn", "id"), F.struct("end.turn", "end.id")
    n = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))  # counted only for rows that tie with the end
    taken = copies.filter(F.col("end").isNotNull() & ((at < stop) | ((at == stop) & (n <= F.col("end.size")))))
    if whole:
        return taken.select("row.*")
    first = F.slice(F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), F.col("end.words").cast("int"))
    cut_here = (at == stop) & (n == F.col("end.size")) & (F.col("end.words") < n)
    text = F.when(cut_here, F.array_join(first, "")).otherwise(F.col("text"))
    return taken.select(F.col("row").withField(f"`{text_col}`", text).alias("row")).select("row.*")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fair_mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "virtual_finish")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS turn
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM s
), w AS (
  SELECT *, 2 * source_size AS cap, ([3, 1, 2])[(rk % 3)::INT + 1]::BIGINT AS w FROM r
), c AS (
  SELECT *, (3 * sum(source_size) OVER ())::BIGINT AS share,
    coalesce(sum(cap) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cap_before,
    (sum(w) OVER (ORDER BY cap / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS w_onward
  FROM w
), o AS (
  SELECT *, share - 2 * cap_before AS left_, cap * w_onward * 2 > w * (share - 2 * cap_before) AS is_open FROM c
), l AS (
  SELECT left_ AS l_left, w_onward AS l_w FROM o WHERE is_open ORDER BY cap / w, rk LIMIT 1
), t AS (
  SELECT source, source_size, CASE WHEN is_open THEN (w * l_left)::DOUBLE / (l_w * 2)::DOUBLE ELSE cap::DOUBLE END AS target FROM o LEFT JOIN l ON true
), q AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, coalesce('=' || d.source, '') AS skey,
    (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.turn, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT - d.size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), p AS (
  SELECT skey, start, epoch, start + 256 * k AS place, least(size, 256 * (k + 1)) - 256 * k AS words, (start + least(size, 256 * (k + 1)) + epoch * source_size)::DOUBLE / target AS finish
  FROM (SELECT *, unnest(range(0, (size + 255) // 256)) AS k FROM q, (VALUES (0), (1)) e(epoch) WHERE size > 0 AND target > 0)
), g AS (
  SELECT *, sum(words) OVER (ORDER BY finish, skey, epoch, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - words AS before FROM p
), k AS (
  SELECT skey, start, sum(greatest(0, least(words, (SELECT (sum(size) * 3) // 2 FROM q) - before)))::BIGINT AS taken FROM g GROUP BY skey, start
)
SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN coalesce(taken, 0) ELSE 0 END::BIGINT AS taken,
  CASE WHEN target = 0 THEN NULL ELSE (start + size)::DOUBLE / target END AS virtual_finish
FROM q LEFT JOIN k USING (skey, start)
"""
