"""One query per operator.  Every query runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veritome.functions import completion, text
from veritome.functions.matching import block_array, match_form_of
from veritome.operators import chunking, cleaning, confidence, cost, diff, embedding, fidelity, leakage, neighbours, overview, sections, selection, spans, stats
from veritome.operators import records as record_table
from veritome.plans.views import PAGES_SQL, documents, fidelity_sql, form_sql, pages, records, records_sql, source_pages, table
from veritome.prompts import prompt, render_prompts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
PRICE = cost.Price()

#: Stand-ins for vocabulary that the standard tables' invented prose lacks.
CUES, STRONG = r"\b(?:with|this|from|that)\b", r"\bthat\b"
WORDS_SQL = "regexp_extract_all(lower(context_text), '\\b(?:with|this|from|that)\\b')"


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return d.select("doc", "source", F.lit(1).alias("pages"), F.char_length("text").alias("chars"), text.approx_tokens(F.col("text")).alias("tokens"))


TOKENS_SQL = "CASE WHEN length({x}) = 0 THEN 0 ELSE greatest(1, round_even(length({x}) / 4.0, 0)) END::BIGINT"


# ---------------------------------------------------------------- sizes and projections
@query("corpus_frame", f"SELECT coalesce(source, 'TOTAL') AS source, grouping(source)::TINYINT AS is_total, count(*) AS pages, sum(length(text))::BIGINT AS chars, sum({TOKENS_SQL.format(x='text')})::BIGINT AS tokens FROM documents GROUP BY GROUPING SETS ((source), ())")
def corpus_frame(spark, sf):
    return overview.corpus_frame(_sizes(spark, sf), "source")


@query("approx_tokens", f"SELECT doc_id, {TOKENS_SQL.format(x='text')} AS tokens FROM documents")
def approx_tokens(spark, sf):
    return documents(spark, sf).select("doc_id", text.approx_tokens(F.col("text")).alias("tokens"))


@query("document_profile", f"WITH {PAGES_SQL} SELECT doc, count(*) AS n_pages, sum(length(text))::BIGINT AS n_chars, sha256(string_agg(text, chr(10) || chr(10) ORDER BY page)) AS sha256 FROM pages_v GROUP BY doc")
def document_profile(spark, sf):
    return overview.profiles(pages(spark, sf))


@query("page_lookup", f"WITH {PAGES_SQL} SELECT doc, page, text FROM pages_v WHERE page = 2")
def page_lookup(spark, sf):
    return pages(spark, sf).filter("page = 2")


@query("short_names", "SELECT doc_id, CASE WHEN len(string_split(n, '_')) > 3 THEN array_to_string(string_split(n, '_')[1:3], '_') ELSE n END AS short FROM (SELECT doc_id, 'a_' || source || '_' || lang || '_x' AS n FROM documents)")
def short_names(spark, sf):
    return documents(spark, sf).select("doc_id", text.short_name(F.concat_ws("_", F.lit("a"), "source", "lang", F.lit("x.pdf"))).alias("short"))


@query("clipped_text", "SELECT doc_id, CASE WHEN length(text) > 110 THEN rtrim(left(text, 109), ' ') || '…' ELSE text END AS clipped FROM documents")
def clipped_text(spark, sf):
    return documents(spark, sf).select("doc_id", text.clip(F.col("text")).alias("clipped"))


@query("run_id_parts", r"SELECT event_id, coalesce(nullif(trim(regexp_replace(event_type || '/' || user_id, '[^A-Za-z0-9._\-]+', '-', 'g'), '-'), ''), 'x') AS slug FROM events")
def run_id_parts(spark, sf):
    return table(spark, sf, "events").select("event_id", text.slug(F.concat_ws("/", "event_type", F.col("user_id").cast("string"))).alias("slug"))


# ---------------------------------------------------------------- cleaning
@query("collapse_spaces", r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, ' {2,}', ' ', 'g'), '(?m)^[ \t]+|[ \t]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS html FROM pages")
def collapse_spaces(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.collapse_spaces(F.col("html")).alias("html"))


LINES_SQL = "lines AS (SELECT doc_id, source, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents))"
KEY_SQL = r"regexp_replace(lower(trim(regexp_replace(line, '\s+', ' ', 'g'), ' ')), '\d+', '#', 'g')"


@query("line_keys", f"WITH {LINES_SQL} SELECT doc_id, i::INT AS i, {KEY_SQL} AS key FROM lines")
def line_keys(spark, sf):
    lines = documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    return lines.select("doc_id", (F.col("i") + 1).alias("i"), text.line_key(F.col("line")).alias("key"))


@query("page_number_lines", rf"WITH {LINES_SQL} SELECT doc_id, i::INT AS i FROM lines WHERE regexp_matches(trim(line), '^(?i:(?:page\s+|p\.\s*|-\s*)?\d{{1,4}}(?:\s*(?:/|of|de)\s*\d{{1,4}})?(?:\s*-)?)$')")
def page_number_lines(spark, sf):
    lines = documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    return lines.filter(text.is_page_number(F.col("line"))).select("doc_id", (F.col("i") + 1).alias("i"))


EDGES_SQL = rf"""{LINES_SQL}, seen AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS up, row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) AS down FROM lines WHERE trim(line) <> ''),
keys AS (SELECT DISTINCT source, doc_id, {KEY_SQL} AS key FROM seen WHERE (up <= 3 OR down <= 3) AND length(line) <= 120),
n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
hits AS (SELECT k.source, key, count(*) AS n_pages FROM keys k JOIN n USING (source) WHERE key <> '' GROUP BY k.source, key, n.n HAVING count(*) >= greatest(2, ceil(n.n * 0.1)))"""


@query("repeated_edge_lines", f"WITH {EDGES_SQL} SELECT source AS doc, key, n_pages FROM hits")
def repeated_edge_lines(spark, sf):
    return cleaning.repeated_edges(source_pages(spark, sf), 0.1)


@query(
    "strip_repeated_lines",
    f"WITH {EDGES_SQL}, gone AS (SELECT s.doc_id, s.i FROM seen s JOIN hits h ON s.source = h.source AND h.key = {KEY_SQL} WHERE (up <= 3 OR down <= 3) AND length(line) <= 120) SELECT l.source AS doc, l.doc_id::INT AS page, coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS text FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.source, l.doc_id",
)
def strip_repeated_lines(spark, sf):
    return cleaning.strip_repeated_lines(source_pages(spark, sf), 0.1)


@query(
    "vocabulary",
    r"""WITH w AS (SELECT DISTINCT source, unnest(regexp_extract_all(lower(text), '\p{L}+(?:-\p{L}+)*')) AS w FROM documents), p AS (SELECT source, w, string_split(w, '-') AS p FROM w),
f AS (SELECT source, w AS f FROM p UNION SELECT source, unnest(p) FROM p UNION SELECT source, unnest(list_transform(range(1, len(p)), lambda i: p[i] || '-' || p[i + 1])) FROM p WHERE len(p) > 1)
SELECT source AS doc, list_sort(list(f)) AS vocabulary FROM f GROUP BY source""",
)
def vocabulary(spark, sf):
    return cleaning.vocabulary(source_pages(spark, sf))


@query(
    "vocabulary_rows",
    r"""WITH w AS (SELECT DISTINCT source, unnest(regexp_extract_all(lower(text), '\p{L}+(?:-\p{L}+)*')) AS w FROM documents), p AS (SELECT source, w, string_split(w, '-') AS p FROM w)
SELECT source AS doc, w FROM p UNION SELECT source, unnest(p) FROM p UNION SELECT source, unnest(list_transform(range(1, len(p)), lambda i: p[i] || '-' || p[i + 1])) FROM p WHERE len(p) > 1""",
)
def vocabulary_rows(spark, sf):
    return cleaning.word_forms(source_pages(spark, sf)).distinct()


@query("clean_pages")
def clean_pages(spark, sf):
    return cleaning.clean_pages(source_pages(spark, sf), 0.1)


@query("thin_documents", f"WITH {PAGES_SQL} SELECT doc, sum(length(text))::BIGINT AS n_chars, count(*) AS n_pages FROM pages_v GROUP BY doc HAVING sum(length(text)) < 60 * count(*)")
def thin_documents(spark, sf):
    return cleaning.split_by_density(pages(spark, sf), 60)[1]


# ---------------------------------------------------------------- chunks, spans, selection
@query("fixed_chunks", "SELECT doc, 1 AS page, k::INT AS chunk, (k * 400)::INT AS start, least(k * 400 + 500, length(text))::INT AS \"end\", substr(text, (k * 400 + 1)::BIGINT, 500) AS text FROM (SELECT 'd' || doc_id AS doc, text, unnest(range(0, greatest(0, ceil((length(text) - 500) / 400.0))::BIGINT + 1)) AS k FROM documents WHERE length(text) > 0)")
def fixed_chunks(spark, sf):
    one = documents(spark, sf, heavy=True).select("doc", F.lit(1).alias("page"), "text")
    return chunking.hard_chunks(one, 500, 100)


@query("natural_chunks")
def natural_chunks(spark, sf):
    one = documents(spark, sf, heavy=True).select("doc", F.lit(1).alias("page"), "text")
    return chunking.chunk_pages(one, 1200, 200)


@query("first_pages", f"WITH {PAGES_SQL} SELECT doc, page, text FROM pages_v WHERE page <= 3 AND trim(text) <> ''")
def first_pages(spark, sf):
    return selection.first_pages(pages(spark, sf), 3)


def _render_sql(cond: str) -> str:
    return f"SELECT doc, string_agg('[p. ' || page || ']' || chr(10) || trim(text), chr(10) || chr(10) ORDER BY page) AS context_text FROM pages_v WHERE {cond} GROUP BY doc"


@query("render_context", f"WITH {PAGES_SQL}, r AS ({_render_sql(chr(112) + 'age <= 3 AND trim(text) <> ' + chr(39) * 2)}) SELECT doc, coalesce(context_text, '') AS context_text FROM (SELECT DISTINCT doc FROM pages_v) LEFT JOIN r USING (doc)")
def render_context(spark, sf):
    contexts = selection.select_contexts(pages(spark, sf), selection.FirstPages(3))
    return contexts.select("doc", selection.rendered(F.col("chunks")).alias("context_text"))


@query(
    "split_blocks",
    f"WITH {records_sql('a')} SELECT doc, (generate_subscripts(pages, 1) - 1)::INT AS ord, generate_subscripts(pages, 1)::INT AS page, unnest(pages) AS text FROM rec_a",
)
def split_blocks(spark, sf):
    return records(spark, sf, "a").select("doc", F.inline(block_array(F.col("context_text"))))


@query("split_sentences", rf"WITH {LINES_SQL}, s AS (SELECT doc_id, generate_subscripts(p, 1) AS at, unnest(p) AS sentence FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+([A-Z0-9(\[])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS p FROM documents)) SELECT doc_id, count(*) AS n FROM s WHERE trim(sentence, ' ' || chr(10)) <> '' GROUP BY doc_id")
def split_sentences(spark, sf):
    return documents(spark, sf).select("doc_id", F.explode(text.sentences(F.col("text")))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("keyword_selection")
def keyword_selection(spark, sf):
    return selection.select_contexts(pages(spark, sf), selection.Keyword())


@query("semantic_selection")
def semantic_selection(spark, sf):
    one = documents(spark, sf, heavy=True).select("doc", F.lit(1).alias("page"), "text")
    return selection.select_contexts(one, selection.Semantic(max_chars=2400))


@query("hybrid_selection")
def hybrid_selection(spark, sf):
    one = documents(spark, sf, heavy=True).select("doc", F.lit(1).alias("page"), "text")
    return selection.select_contexts(one, selection.Hybrid(max_chars=2400, cues=CUES, strong_cues=STRONG))


@query("hashing_vectors")
def hashing_vectors(spark, sf):
    return embedding.embed_column(documents(spark, sf, heavy=True).select("doc_id", F.col("text"))).select("doc_id", "vector")


TOPK_SQL = """WITH q AS (SELECT vec_id AS query, embedding AS q FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT e.label AS doc, e.vec_id AS chunk, q.query, list_sum(list_transform(list_zip(e.embedding, q.q), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) AS sim FROM embeddings e, q),
r AS (SELECT *, row_number() OVER (PARTITION BY doc, query ORDER BY sim DESC, chunk) AS rk FROM s)
SELECT doc, chunk, round(max(sim), 6) AS score FROM r WHERE rk <= 6 GROUP BY doc, chunk"""


@query("semantic_topk", TOPK_SQL)
def semantic_topk(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").alias("doc"), F.col("vec_id").alias("chunk"), F.col("embedding").alias("vector"))
    queries = e.filter("chunk % 100 = 0").select(F.col("chunk").alias("query"), F.concat(F.lit("q"), F.col("chunk").cast("string")).alias("label"), "vector")
    return spans.top_chunks(e, queries, 6).drop("label")


@query("nearest_vectors")
def nearest_vectors(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return neighbours.nearest(e, e.filter("id % 100 = 0"), 6).select("query", "id", F.round("score", 6).alias("score"))


SPANS_SQL = "sp AS (SELECT user_id % 50 AS k, (event_id * 37 % 5000)::INT AS start, (event_id * 37 % 5000 + 20 + event_id % 60)::INT AS \"end\", (event_id % 11) / 10.0::DOUBLE AS score FROM events)"


def _spans(spark, sf):
    i = F.col("event_id")
    start = (i * 37 % 5000).cast("int")
    return table(spark, sf, "events").select("event_id", (F.col("user_id") % 50).alias("k"), start.alias("start"), (start + 20 + i % 60).cast("int").alias("end"), ((i % 11) / 10.0).alias("score"))


@query(
    "merge_spans",
    f"""WITH {SPANS_SQL}, m AS (SELECT *, max("end") OVER (PARTITION BY k ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT k, min(start) AS start, max("end") AS "end", count(*) AS n, max(score) AS score FROM g GROUP BY k, island""",
)
def merge_spans(spark, sf):
    return spans.merge_spans(_spans(spark, sf), ["k"], score="score")


@query(
    "uncovered_spans",
    """WITH sp AS (SELECT event_id, user_id % 50 AS k, (event_id * 37 % 5000)::INT AS start, (event_id * 37 % 5000 + 20 + event_id % 60)::INT AS "end", (event_id % 11) / 10.0::DOUBLE AS score FROM events),
p AS (SELECT k, event_id, score, unnest(range(start, "end")) AS p FROM sp), o AS (SELECT k, p, arg_min(event_id, [-score, event_id]) AS event_id FROM p GROUP BY k, p), n AS (SELECT event_id, count(*) AS fresh FROM o GROUP BY event_id)
SELECT event_id, k, start, "end", coalesce(fresh, 0) AS fresh FROM sp LEFT JOIN n USING (event_id)""",
)
def uncovered_spans(spark, sf):
    return spans.uncovered(_spans(spark, sf), ["k"], [-F.col("score"), F.col("event_id")]).drop("score")


@query(
    "skip_greedy_budget",
    """WITH RECURSIVE i AS (SELECT o_custkey % 100 AS k, o_orderkey AS id, (o_orderkey % 97 + 3)::BIGINT AS size, row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders),
f AS (SELECT k, id, place, size <= 500 AS taken, CASE WHEN size <= 500 THEN size ELSE 0 END AS used FROM i WHERE place = 1
UNION ALL SELECT i.k, i.id, i.place, f.used + i.size <= 500, CASE WHEN f.used + i.size <= 500 THEN f.used + i.size ELSE f.used END FROM f JOIN i ON i.k = f.k AND i.place = f.place + 1)
SELECT k, id FROM f WHERE taken""",
)
def skip_greedy_budget(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 100).alias("k"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 97 + 3).alias("size"), "o_totalprice")
    return spans.fitting(o, ["k"], "size", [F.col("o_totalprice").desc(), F.col("id")], 500).select("k", "id")


def _contexts(spark, sf):
    return selection.select_contexts(pages(spark, sf), selection.FirstPages(3))


@query(
    "limitation_sentences",
    rf"WITH {PAGES_SQL}, s AS (SELECT doc, page, unnest(string_split(regexp_replace(text, '([.!?])\s+([A-Z0-9(\[])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS sentence FROM pages_v) SELECT doc, page, trim(sentence) AS sentence FROM s WHERE regexp_matches(sentence, '(?i)\b(?:with|this|from|that)\b')",
)
def limitation_sentences(spark, sf):
    return overview.limitation_sentences(pages(spark, sf), CUES)


@query(
    "recall_table",
    rf"""WITH {PAGES_SQL}, s AS (SELECT doc, page, unnest(string_split(regexp_replace(text, '([.!?])\s+([A-Z0-9(\[])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS sentence FROM pages_v),
l AS (SELECT doc, left(trim(lower(regexp_replace(sentence, '\s+', ' ', 'g')), ' '), 80) AS key FROM s WHERE regexp_matches(sentence, '(?i)\b(?:with|this|from|that)\b')),
c AS (SELECT doc, trim(lower(regexp_replace(coalesce(string_agg(text, ' ' ORDER BY page) FILTER (WHERE page <= 3 AND trim(text) <> ''), ''), '\s+', ' ', 'g')), ' ') AS sent, coalesce(sum(length(text)) FILTER (WHERE page <= 3 AND trim(text) <> ''), 0) AS n_chars FROM pages_v GROUP BY doc),
d AS (SELECT c.doc, any_value(n_chars) AS n_chars, count(key) AS n, count(*) FILTER (WHERE contains(sent, key)) AS hit FROM c LEFT JOIN l USING (doc) GROUP BY c.doc)
SELECT 'first_pages' AS strategy, count(*) FILTER (WHERE n > 0) AS docs_with_sentences, count(*) FILTER (WHERE hit > 0) AS docs_covered, sum(n)::BIGINT AS sentences, sum(hit)::BIGINT AS in_context, round(sum(hit)::DOUBLE / sum(n), 3) AS recall, round_even(avg(n_chars), 0)::BIGINT AS mean_chars FROM d""",
)
def recall_table(spark, sf):
    return overview.recall_table(overview.limitation_recall(pages(spark, sf), _contexts(spark, sf), CUES))


@query("budget_curve")
def budget_curve(spark, sf):
    one = documents(spark, sf, heavy=True).select("doc", F.lit(1).alias("page"), "text")
    return overview.budget_curve(one, selection.Hybrid(cues=CUES, strong_cues=STRONG), (600, 1200, None), CUES)


@query(
    "final_pages_share",
    rf"WITH {PAGES_SQL}, s AS (SELECT doc, page, unnest(string_split(regexp_replace(text, '([.!?])\s+([A-Z0-9(\[])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS sentence FROM pages_v), n AS (SELECT doc, count(*) AS n FROM pages_v GROUP BY doc) SELECT count(*) FILTER (WHERE page > n * (1 - 1.0::DOUBLE / 3)) / count(*)::DOUBLE AS share FROM s JOIN n USING (doc) WHERE regexp_matches(sentence, '(?i)\b(?:with|this|from|that)\b')",
)
def final_pages_share(spark, sf):
    return overview.final_pages_share(pages(spark, sf), pattern=CUES)


FIRST_SQL = f"""{PAGES_SQL}, sel AS (SELECT doc, count(*) AS n_chunks, length(string_agg('[p. ' || page || ']' || chr(10) || trim(text), chr(10) || chr(10) ORDER BY page)) AS chars, string_agg(page::VARCHAR, ', ' ORDER BY page) AS pages_sent FROM pages_v WHERE page <= 3 AND trim(text) <> '' GROUP BY doc),
alld AS (SELECT doc, sum(length(text)) AS n_chars FROM pages_v GROUP BY doc),
frame AS (SELECT 'first_pages' AS strategy, doc, coalesce(pages_sent, '') AS pages_sent, coalesce(n_chunks, 0)::INT AS n_chunks, coalesce(chars, 0)::INT AS chars, CASE WHEN coalesce(chars, 0) = 0 THEN 0 ELSE greatest(1, round_even(chars / 4.0, 0)) END::BIGINT AS tokens, CASE WHEN n_chars = 0 THEN 0.0 ELSE coalesce(chars, 0) / n_chars::DOUBLE END AS share FROM alld LEFT JOIN sel USING (doc))"""


@query("selection_frame", f"WITH {FIRST_SQL} SELECT * FROM frame")
def selection_frame(spark, sf):
    return overview.selection_frame(_contexts(spark, sf), overview.profiles(pages(spark, sf)))


@query("strategy_summary", f"WITH {FIRST_SQL} SELECT strategy, round_even(avg(n_chunks), 1) AS mean_chunks, round_even(avg(chars), 0)::BIGINT AS mean_chars, round_even(avg(tokens), 0)::BIGINT AS mean_tokens, sum(tokens)::BIGINT AS corpus_tokens, round_even(avg(share), 3) AS mean_share FROM frame GROUP BY strategy")
def strategy_summary(spark, sf):
    return overview.strategy_summary(selection_frame(spark, sf))


# ---------------------------------------------------------------- places in texts
#: Stand-ins for headings that the standard tables' invented prose lacks.
HEADS = (("the", r"the(?:re)?"), ("of", r"of|for"), ("in", r"in(?:\s+the)?"))
ENDS = r"(?dim)^(?:and|is|was)\b[^\n]*"
NUMBER_SQL = r"(?:\d{1,2}(?:\.\d{1,2})*\.?|[IVX]{1,5}\.?|[A-H]\.)[ \t]+"


@query("match_positions", rf"""WITH {PAGES_SQL}, m AS (SELECT doc, page, regexp_extract_all(text, '\p{{Lu}}\p{{L}}*') AS m, regexp_split_to_array(text, '\p{{Lu}}\p{{L}}*') AS g FROM pages_v),
r AS (SELECT doc, page, generate_subscripts(m, 1) AS i, unnest(m) AS text, unnest(g[1:len(m)]) AS gap FROM m)
SELECT doc, page, (e - length(text))::INT AS start, e::INT AS "end", text FROM (SELECT *, sum(length(gap) + length(text)) OVER (PARTITION BY doc, page ORDER BY i) AS e FROM r)""")
def match_positions(spark, sf):
    return sections.match_rows(pages(spark, sf), "text", r"\p{Lu}\p{L}*")


HEADS_SQL = rf"""{PAGES_SQL}, numbered AS (SELECT doc, page, text, regexp_extract(text, '^(?i:{NUMBER_SQL})') AS num FROM pages_v),
parts AS (SELECT *, substr(text, length(num) + 1) AS rest FROM numbered),
fits AS (SELECT doc, page, num, """ + ", ".join(rf"CASE WHEN num <> '' THEN regexp_extract(rest, '^((?i:{w}))\b', 1) ELSE '' END AS n{i}, CASE WHEN regexp_matches(text, '^(?i:{w})[ \t]*(?:[.:—–]|$)') THEN regexp_extract(text, '^((?i:{w}))[ \t]*(?:[.:—–]|$)', 1) ELSE regexp_extract(text, '^((?i:{w}))[ \t]+[^.:]{{1,60}}$', 1) END AS u{i}" for i, (_, w) in enumerate(HEADS)) + """ FROM parts),
best AS (SELECT doc, page, num, CASE """ + " ".join(f"WHEN n{i} <> '' THEN {i}" for i in range(len(HEADS))) + " " + " ".join(f"WHEN u{i} <> '' THEN {i}" for i in range(len(HEADS))) + """ END AS rank, CASE """ + " ".join(f"WHEN n{i} <> '' THEN n{i}" for i in range(len(HEADS))) + " " + " ".join(f"WHEN u{i} <> '' THEN u{i}" for i in range(len(HEADS))) + " END AS words, " + " OR ".join(f"n{i} <> ''" for i in range(len(HEADS))) + f""" AS has FROM fits),
heads AS (SELECT doc, page, 0 AS start, {[name for name, _ in HEADS]}[rank + 1] AS section, rank::INT AS rank, CASE WHEN has THEN num ELSE '' END || words AS label FROM best WHERE regexp_matches(words, '^[A-Z]'))"""


@query("headings", f"WITH {HEADS_SQL} SELECT * FROM heads")
def headings(spark, sf):
    return sections.headings(pages(spark, sf), HEADS)


@query(
    "section_extents",
    rf"""WITH {HEADS_SQL}, marks AS (SELECT doc, page, section, label FROM heads UNION ALL SELECT doc, page, NULL, NULL FROM pages_v WHERE regexp_matches(text, '^(?i:(?:and|is|was)\b)')),
o AS (SELECT *, bool_or(section IS NULL) OVER w AS ended, lead(page) OVER w AS until FROM marks WINDOW w AS (PARTITION BY doc ORDER BY page)),
t AS (SELECT doc, page, length(text) AS n, length(text) - length(ltrim(text)) AS blank FROM pages_v)
SELECT o.doc, section, label, o.page AS head_page, 0 AS head_start, t.page, CASE WHEN t.page = o.page THEN 0 ELSE blank END::INT AS start,
greatest(CASE WHEN t.page = o.page THEN 0 ELSE blank END, CASE WHEN t.page = until THEN 0 ELSE n END)::INT AS stop
FROM o JOIN t ON t.doc = o.doc AND t.page >= o.page AND (until IS NULL OR t.page <= until) WHERE NOT ended""",
)
def section_extents(spark, sf):
    p = pages(spark, sf)
    return sections.section_extents(p, sections.headings(p, HEADS), sections.references(p, ENDS))


@query(
    "sentence_windows",
    rf"""WITH {PAGES_SQL}, m AS (SELECT doc, page, text, regexp_extract_all(text, '[^.!?\n]+(?:[.!?]+["'')\]]*)?') AS m, regexp_split_to_array(text, '[^.!?\n]+(?:[.!?]+["'')\]]*)?') AS g FROM pages_v),
r AS (SELECT doc, page, length(text) AS n, generate_subscripts(m, 1) AS i, unnest(m) AS s, unnest(g[1:len(m)]) AS gap FROM m),
e AS (SELECT *, sum(length(gap) + length(s)) OVER (PARTITION BY doc, page ORDER BY i) AS stop FROM r),
w AS (SELECT doc, page, i, s, stop - length(s) AS begin, stop FROM e WHERE (regexp_matches(s, '[.!?]["'')\]]*$') OR stop >= n) AND trim(s) <> ''),
x AS (SELECT *, lag(begin) OVER o AS before, lag(s) OVER o AS s0, lead(stop) OVER o AS after FROM w WINDOW o AS (PARTITION BY doc, page ORDER BY i)),
y AS (SELECT *, CASE WHEN stop - before <= 600 THEN before ELSE begin END AS low, CASE WHEN stop - before <= 600 THEN s0 ELSE s END AS lead_s FROM x)
SELECT doc, page, (low + length(lead_s) - length(ltrim(lead_s)))::INT AS start, (CASE WHEN after - low <= 600 THEN after ELSE stop END)::INT AS "end", begin::INT AS sentence, lower(regexp_extract(s, '(?i){CUES}')) AS word, NOT regexp_matches(s, '(?i){STRONG}') AS weak
FROM y WHERE regexp_matches(s, '(?i){CUES}')""",
)
def sentence_windows(spark, sf):
    return sections.sentence_windows(pages(spark, sf), CUES, STRONG)


# ---------------------------------------------------------------- completions, prompts, runs
FORMS = 6


def _raw(spark, sf):
    """Raw outputs whose fault is known from the id."""
    quote = F.concat(F.lit("quote number "), F.col("doc_id").cast("string"), F.lit(" of the corpus"))
    card = F.concat(F.lit('{"problema": "p", "dados": "d", "metodo": "m", "metrica": "x", "limitacao": null, "evidencia": {"trecho": "'), quote, F.lit('", "pagina": 3}}'))
    i = F.col("doc_id") % FORMS
    raw = (
        F.when(i == 0, card)
        .when(i == 1, F.concat(F.lit("```json\n"), card, F.lit("\n```")))
        .when(i == 2, F.replace(card, F.lit("3}"), F.lit("3,}")))
        .when(i == 3, F.left(card, F.lit(60)))
        .when(i == 4, F.replace(card, F.lit("null"), F.lit('"N/A"')))
        .otherwise(F.replace(card, F.lit("3}"), F.lit('"p. 3"}')))
    )
    return documents(spark, sf).select("doc_id", raw.alias("raw"))


@query(
    "parse_completions",
    """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'ok' WHEN 3 THEN 'failed' ELSE 'repaired' END AS status, doc_id % 6 IN (0, 4) AS first_try,
CASE doc_id % 6 WHEN 1 THEN 'cercas_de_codigo' WHEN 2 THEN 'virgula_final' WHEN 4 THEN 'limitacao_sentinela' WHEN 5 THEN 'pagina_para_int' ELSE '' END AS repairs,
CASE WHEN doc_id % 6 <> 3 THEN 'quote number ' || doc_id || ' of the corpus' END AS quote, CASE WHEN doc_id % 6 <> 3 THEN 3 END::BIGINT AS page FROM documents""",
)
def parse_completions(spark, sf):
    p = _raw(spark, sf).select("doc_id", completion.parsed(F.col("raw")).alias("p"))
    return p.select("doc_id", "p.status", "p.first_try", F.array_join("p.repairs", ",").alias("repairs"), F.col("p.card.evidence.quote").alias("quote"), F.col("p.card.evidence.page").alias("page"))


@query("json_fields", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def json_fields(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


def _prompt_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    p = prompt("v_full")
    before, after = p.around()
    return f"WITH {records_sql('a')} SELECT doc, 'v_full' AS prompt_variant, left(sha256({quoted(p.system())} || chr(10) || {quoted(before)} || context_text || {quoted(after)}), 12) AS prompt_sha FROM rec_a"


@query("prompt_hashes", _prompt_sql())
def prompt_hashes(spark, sf):
    return render_prompts(records(spark, sf, "a").select("doc", "context_text"), "v_full").select("doc", "prompt_variant", "prompt_sha")


@query(
    "run_summary",
    f"""WITH {records_sql('a')}, {records_sql('b')}, r AS (SELECT * FROM rec_a UNION ALL SELECT * FROM rec_b)
SELECT run_id, count(*) AS n, count(*) FILTER (WHERE parse_status = 'ok') AS n_ok, count(*) FILTER (WHERE parse_status = 'repaired') AS n_repaired, count(*) FILTER (WHERE parse_status = 'failed') AS n_failed,
count(*) FILTER (WHERE first_try) AS n_first_try, round(count(*) FILTER (WHERE first_try) / count(*)::DOUBLE, 4) AS rate_first_try, count(*) FILTER (WHERE NOT failed AND limitation IS NULL) AS n_limitation_null,
sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round(sum(latency_s), 3) AS latency_s FROM r GROUP BY run_id""",
)
def run_summary(spark, sf):
    return stats.run_summary(records(spark, sf, "a").unionByName(records(spark, sf, "b")), "run_id")


@query("repair_counts", f"WITH {records_sql('a')} SELECT run_id, 'virgula_final' AS repair, count(*) AS n FROM rec_a WHERE parse_status = 'repaired' GROUP BY run_id")
def repair_counts(spark, sf):
    return stats.repair_counts(records(spark, sf, "a"), "run_id")


@query("records_by_document", f"WITH {records_sql('a')}, {records_sql('b')}, r AS (SELECT * FROM rec_a UNION ALL SELECT * FROM rec_b) SELECT doc, string_agg(run_id || ':' || parse_status, ',' ORDER BY run_id) AS runs FROM r GROUP BY doc")
def records_by_document(spark, sf):
    rows = record_table.by_document(records(spark, sf, "a").unionByName(records(spark, sf, "b")), "run_id", "parse_status")
    return rows.select("doc", F.array_join(F.transform("records", lambda r: F.concat_ws(":", r["run_id"], r["parse_status"])), ",").alias("runs"))


@query("flat_cards", f"WITH {records_sql('a')} SELECT doc, problem, data, method, metric, limitation, quote, page::BIGINT AS page FROM rec_a WHERE NOT failed")
def flat_cards(spark, sf):
    return record_table.flat_cards(records(spark, sf, "a"))


@query("reparse", "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'ok' WHEN 3 THEN 'failed' ELSE 'repaired' END AS parse_status, doc_id % 6 IN (0, 4) AS first_try FROM documents")
def reparse(spark, sf):
    return record_table.reparse(_raw(spark, sf).withColumnRenamed("raw", "raw_output")).select("doc_id", "parse_status", "first_try")


@query("latest_run", "SELECT source, lang, max(doc_id) AS run FROM documents GROUP BY source, lang")
def latest_run(spark, sf):
    return spans.best_k(documents(spark, sf), ["source", "lang"], [F.col("doc_id").desc()], 1).select("source", "lang", F.col("doc_id").alias("run"))


# ---------------------------------------------------------------- fidelity and limitation
FID = f"WITH {records_sql('a')}, {fidelity_sql('a')}"


@query("fidelity", f"{FID} SELECT run_id, doc, found, method, page_claimed, page_found, found AND page_found = page_claimed AS page_ok FROM fid_a".replace("found AND page_found = page_claimed", "coalesce(found AND page_found = page_claimed, false)"))
def check_fidelity(spark, sf):
    return fidelity.check_fidelity(records(spark, sf, "a"), scores=False).drop("score")


@query("fidelity_scores")
def fidelity_scores(spark, sf):
    return fidelity.check_fidelity(records(spark, sf, "a")).select("doc", "method", "score")


@query(
    "fidelity_summary",
    f"{FID}, ok AS (SELECT *, coalesce(found AND page_found = page_claimed, false) AS page_ok FROM fid_a) SELECT run_id, count(*) AS n, count(*) FILTER (WHERE found) AS n_found, count(*) FILTER (WHERE found) / count(*)::DOUBLE AS rate_found, count(*) FILTER (WHERE page_ok) AS n_page_ok, count(*) FILTER (WHERE page_ok) / count(*)::DOUBLE AS rate_page_ok, count(*) FILTER (WHERE method = 'exact') AS n_exact, count(*) FILTER (WHERE method = 'fuzzy') AS n_fuzzy, count(*) FILTER (WHERE method = 'none') AS n_none FROM ok GROUP BY run_id",
)
def fidelity_summary(spark, sf):
    return fidelity.fidelity_summary(fidelity.check_fidelity(records(spark, sf, "a"), scores=False), "run_id")


@query("quotes_not_found", f"{FID} SELECT doc, method FROM fid_a WHERE NOT found")
def quotes_not_found(spark, sf):
    return fidelity.check_fidelity(records(spark, sf, "a"), scores=False).filter("not found").select("doc", "method")


@query("match_forms", f"WITH {records_sql('a')} SELECT doc, {form_sql('problem')} AS form FROM rec_a WHERE NOT failed")
def match_forms(spark, sf):
    return records(spark, sf, "a").filter("card is not null").select("doc", match_form_of(F.col("card.problem")).alias("form"))


@query(
    "page_of_offset",
    f"""WITH {records_sql('a')}, f AS (SELECT doc, generate_subscripts(pages, 1)::INT AS page, length({form_sql('unnest(pages)')}) AS n FROM rec_a),
p AS (SELECT doc, page, (sum(n + 1) OVER (PARTITION BY doc ORDER BY page ROWS UNBOUNDED PRECEDING)) - n - 1 AS start, n FROM f), o AS (SELECT doc, unnest([10, 300, 1500, 9000])::INT AS "offset" FROM rec_a)
SELECT o.doc, "offset", min(page)::INT AS page FROM o LEFT JOIN p ON p.doc = o.doc AND "offset" BETWEEN start AND start + n GROUP BY o.doc, "offset\"""",
)
def page_of_offset(spark, sf):
    r = records(spark, sf, "a").select("doc", "context_text")
    return fidelity.page_of_offset(r, r.select("doc", F.explode(F.array(*map(F.lit, (10, 300, 1500, 9000)))).alias("offset")))


LIMIT_SQL = f"""lim AS (SELECT run_id, doc, CASE WHEN failed THEN NULL ELSE limitation IS NULL END AS limitation_is_null, list_sort(list_distinct({WORDS_SQL})) AS words, failed FROM rec_a),
lv AS (SELECT run_id, doc, limitation_is_null, words, CASE WHEN failed THEN 'sem_ficha' WHEN limitation_is_null THEN CASE WHEN len(words) > 0 THEN 'null_suspeito' ELSE 'null_ok' END WHEN len(words) > 0 THEN 'preenchida_com_suporte' ELSE 'preenchida_sem_suporte' END AS verdict FROM lim)"""


@query("limitation_verdicts", f"WITH {records_sql('a')}, {LIMIT_SQL} SELECT *, CASE WHEN verdict <> 'sem_ficha' THEN verdict <> 'preenchida_sem_suporte' END AS supported FROM lv")
def limitation_verdicts(spark, sf):
    return fidelity.check_limitation(records(spark, sf, "a"), CUES)


# ---------------------------------------------------------------- comparison of runs
BOTH = f"WITH {records_sql('a')}, {records_sql('b')}"
GAPPED = f"WITH {records_sql('a', gaps=True)}, {records_sql('b', gaps=True)}"
FIELD_SQL = [(f, c) for f, c in zip(("problem", "data", "method", "metric", "limitation", "evidence.quote", "evidence.page"), ("problem", "data", "method", "metric", "limitation", "quote", "page"), strict=True)]
DIFF_SQL = "diffs AS (" + " UNION ALL ".join(f"SELECT a.doc, '{f}' AS field, a.{c}::VARCHAR AS a, b.{c}::VARCHAR AS b FROM rec_a a JOIN rec_b b USING (doc) WHERE NOT a.failed AND NOT b.failed" for f, c in FIELD_SQL) + f"), eq AS (SELECT *, CASE WHEN a IS NULL OR b IS NULL THEN a IS NULL AND b IS NULL ELSE {form_sql('a')} = {form_sql('b')} END AS equal FROM diffs)"


def _diffs(spark, sf):
    return diff.field_diffs(records(spark, sf, "a"), records(spark, sf, "b"))


@query("field_diffs", f"{BOTH}, {DIFF_SQL} SELECT doc, field, a, b, equal FROM eq")
def field_diffs(spark, sf):
    return _diffs(spark, sf).drop("similarity")


@query("field_similarities")
def field_similarities(spark, sf):
    return _diffs(spark, sf).select("doc", "field", "similarity")


@query("unpaired_documents", f"{GAPPED} SELECT coalesce(a.doc, b.doc) AS doc, CASE WHEN a.doc IS NULL THEN 'ausente em A' WHEN b.doc IS NULL THEN 'ausente em B' ELSE 'extração falhou em ' || concat_ws(' e ', CASE WHEN a.failed THEN 'A' END, CASE WHEN b.failed THEN 'B' END) END AS reason FROM rec_a a FULL JOIN rec_b b ON a.doc = b.doc WHERE a.doc IS NULL OR b.doc IS NULL OR a.failed OR b.failed")
def unpaired_documents(spark, sf):
    return diff.unpaired(records(spark, sf, "a", gaps=True), records(spark, sf, "b", gaps=True))


@query("diff_summary", f"{BOTH}, {DIFF_SQL}, d AS (SELECT doc, bool_and(equal) AS same FROM eq GROUP BY doc) SELECT count(*) AS n_pairs, count(*) FILTER (WHERE same) AS n_identical, count(*) FILTER (WHERE same) / count(*)::DOUBLE AS rate_identical FROM d")
def diff_summary(spark, sf):
    return diff.diff_summary(_diffs(spark, sf))


@query("unstable_fields", f"{BOTH}, {DIFF_SQL} SELECT field, count(*) FILTER (WHERE NOT equal) / count(*)::DOUBLE AS change_rate FROM eq GROUP BY field")
def unstable_fields(spark, sf):
    return diff.field_summary(_diffs(spark, sf)).drop("mean_similarity")


ORDER_SQL = "list_position(['problem', 'data', 'method', 'metric', 'limitation', 'evidence.quote', 'evidence.page'], field)"


@query("changes_by_document", f"{BOTH}, {DIFF_SQL} SELECT doc, count(*) FILTER (WHERE NOT equal) AS n_changed, coalesce(string_agg(field, ',' ORDER BY {ORDER_SQL}) FILTER (WHERE NOT equal), '') AS changed, count(*) FILTER (WHERE field = 'limitation' AND (a IS NULL) <> (b IS NULL)) AS n_categorical, coalesce(string_agg(field, ',') FILTER (WHERE field = 'limitation' AND (a IS NULL) <> (b IS NULL)), '') AS categorical FROM eq GROUP BY doc")
def changes_by_document(spark, sf):
    out = diff.changes_by_doc(_diffs(spark, sf))
    return out.withColumns({"changed": F.array_join("changed", ","), "categorical": F.array_join("categorical", ",")})


@query("config_warnings", "SELECT * FROM (VALUES ('strategy', ['first_pages'], ['semantic']), ('prompt_variant', ['v_full'], ['v_sem_fewshot']), ('temperature', ['0.0'], ['0.7'])) t(attr, values_a, values_b)")
def config_warnings(spark, sf):
    return diff.config_warnings(records(spark, sf, "a"), records(spark, sf, "b"))


@query("restrict_to", f"{GAPPED} SELECT doc FROM rec_a WHERE doc IN (SELECT doc FROM rec_b)")
def restrict_to(spark, sf):
    return diff.restrict_to(records(spark, sf, "a", gaps=True), records(spark, sf, "b", gaps=True)).select("doc")


# ---------------------------------------------------------------- leakage
MARKER = leakage.Marker(r"\bthe\b", r"\bthis\b", "com_limitacao")


def term_sql(run: str, s: str = "") -> str:
    fields = " UNION ALL ".join(f"SELECT run_id, doc, '{f}' AS field, {c} AS value, context_text FROM rec_{run} WHERE NOT failed AND {c} IS NOT NULL" for f, c in FIELD_SQL[:6])
    return f"terms{s} AS ({fields}), leak{s} AS (SELECT run_id, doc, field, value, regexp_extract(value, '(?i)\\bthe\\b') AS example_value FROM terms{s} WHERE regexp_matches(value, '(?i)\\bthe\\b') AND NOT regexp_matches(context_text, '(?i)\\bthis\\b'))"


TERM_SQL = term_sql("a")


@query("term_leaks", f"WITH {records_sql('a')}, {TERM_SQL} SELECT doc, field, value, example_value FROM leak")
def term_leaks(spark, sf):
    return leakage.term_leaks(records(spark, sf, "a"), (MARKER,)).select("doc", "field", "value", "example_value")


@query("leakage_summary", f"WITH {records_sql('a')}, {TERM_SQL}, h AS (SELECT doc, " + ", ".join(f"max(CASE WHEN field = '{f}' THEN 1 ELSE 0 END) AS \"n_{f.replace('.', '_')}\"" for f, _ in FIELD_SQL[:6]) + " FROM leak GROUP BY doc) SELECT run_id, count(*) AS n, count(h.doc) AS n_with_leak, count(h.doc) / count(*)::DOUBLE AS rate, " + ", ".join(f"coalesce(sum(\"n_{f.replace('.', '_')}\"), 0)::BIGINT AS \"n_{f.replace('.', '_')}\"" for f, _ in FIELD_SQL[:6]) + " FROM rec_a r LEFT JOIN h ON r.doc = h.doc GROUP BY run_id")
def leakage_summary(spark, sf):
    r = records(spark, sf, "a")
    return leakage.leakage_summary(r, leakage.term_leaks(r, (MARKER,)))


@query("copied_fields")
def copied_fields(spark, sf):
    return leakage.copied_fields(records(spark, sf, "a")).select("doc", "field", "similarity", "method", "example_name")


# ---------------------------------------------------------------- statistics and verdicts
def _gold(spark, sf):
    return table(spark, sf, "labels").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc"), (F.col("quality") == 0).alias("declares"))


def _audited(spark, sf, run):
    r = records(spark, sf, run)
    return stats.audited(r, gold=_gold(spark, sf), leaked=leakage.term_leaks(r, (MARKER,)))


def stats_sql(run: str, s: str = "") -> str:
    """CTEs up to stats_<run>: the metrics of a run in one row."""
    return f"""{records_sql(run)}, {fidelity_sql(run)}, {term_sql(run, s)}, x_{run} AS (SELECT r.*, f.found, coalesce(f.found AND f.page_found = f.page_claimed, false) AS page_ok, l.quality = 1 AS expects, r.doc IN (SELECT doc FROM leak{s}) AS leaked FROM rec_{run} r JOIN fid_{run} f USING (doc) LEFT JOIN labels l ON l.doc_id = r.doc_id),
stats_{run} AS (SELECT run_id, count(*) AS n, count(*) FILTER (WHERE first_try) / count(*)::DOUBLE AS rate_first_try, count(*) FILTER (WHERE parse_status = 'ok') / count(*)::DOUBLE AS rate_parse_ok, count(*) FILTER (WHERE parse_status = 'repaired') / count(*)::DOUBLE AS rate_parse_repaired,
count(*) FILTER (WHERE failed) / count(*)::DOUBLE AS rate_parse_failed, count(*) FILTER (WHERE NOT failed AND limitation IS NULL) / count(*) FILTER (WHERE NOT failed)::DOUBLE AS rate_limitation_null,
count(*) FILTER (WHERE NOT failed AND expects AND limitation IS NULL) / count(*) FILTER (WHERE NOT failed AND expects)::DOUBLE AS rate_null_when_expected, count(*) FILTER (WHERE NOT failed AND expects) AS n_null_expected,
count(*) FILTER (WHERE found) / count(*)::DOUBLE AS rate_fidelity, count(*) FILTER (WHERE page_ok) / count(*)::DOUBLE AS rate_page_ok, count(*) FILTER (WHERE leaked) / count(*)::DOUBLE AS rate_fewshot_leak, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens FROM x_{run} GROUP BY run_id)"""


STATS_SQL = f"WITH {stats_sql('a')} SELECT * FROM stats_a"
METRIC_ROWS = " UNION ALL ".join(f"SELECT {i}::INT AS ord, '{m}' AS metric, a.{m}::DOUBLE AS a, b.{m}::DOUBLE AS b, b.{m}::DOUBLE - a.{m}::DOUBLE AS delta FROM stats_a a, stats_b b" for i, m in enumerate(stats.METRICS))


@query("run_stats", STATS_SQL)
def run_stats(spark, sf):
    return stats.run_stats(_audited(spark, sf, "a"), "run_id")


@query("compare_prompts", f"{BOTH}, s AS (SELECT count(*) FILTER (WHERE first_try) / count(*)::DOUBLE AS r FROM rec_a), t AS (SELECT count(*) FILTER (WHERE first_try) / count(*)::DOUBLE AS r FROM rec_b) SELECT CASE WHEN s.r > t.r THEN 'v_full' ELSE 'v_sem_fewshot' END AS winner, 'rate_first_try' AS decided_by FROM s, t WHERE abs(s.r - t.r) > 1e-9")
def compare_prompts(spark, sf):
    return stats.compare_prompts(_audited(spark, sf, "a").unionByName(_audited(spark, sf, "b")), "v_full", "v_sem_fewshot")


@query("compare_inputs", f"{BOTH}, {fidelity_sql('a')}, {fidelity_sql('b')}, s AS (SELECT count(*) FILTER (WHERE found) / count(*)::DOUBLE AS r FROM fid_a), t AS (SELECT count(*) FILTER (WHERE found) / count(*)::DOUBLE AS r FROM fid_b) SELECT CASE WHEN s.r > t.r THEN 'first_pages' ELSE 'semantic' END AS winner, 'rate_fidelity' AS decided_by FROM s, t WHERE abs(s.r - t.r) > 1e-9")
def compare_inputs(spark, sf):
    return stats.compare_inputs(_audited(spark, sf, "a").unionByName(_audited(spark, sf, "b")), "first_pages", "semantic")


@query("side_by_side", f"WITH {stats_sql('a')}, {stats_sql('b', '_b')} {METRIC_ROWS}")
def side_by_side(spark, sf):
    both = _audited(spark, sf, "a").unionByName(_audited(spark, sf, "b"))
    return stats.side_by_side(stats.run_stats(both, "prompt_variant"), "prompt_variant", "v_full", "v_sem_fewshot")


@query(
    "compare_temperatures",
    f"""WITH {stats_sql('a')}, {stats_sql('b', '_b')}, {DIFF_SQL}, d AS (SELECT doc, bool_and(equal) AS same FROM eq GROUP BY doc)
SELECT a.n AS n_t0, b.n AS n_alt, a.rate_first_try AS rate_first_try_t0, b.rate_first_try AS rate_first_try_alt, a.rate_fidelity AS rate_fidelity_t0, b.rate_fidelity AS rate_fidelity_alt,
a.rate_fidelity >= b.rate_fidelity AND a.rate_first_try >= b.rate_first_try AS base_holds, (SELECT count(*) FILTER (WHERE same) / count(*)::DOUBLE FROM d) AS rate_identical FROM stats_a a, stats_b b""",
)
def compare_temperatures(spark, sf):
    return stats.compare_temperatures(records(spark, sf, "a"), records(spark, sf, "b"))


# ---------------------------------------------------------------- confidence
def _assigned(spark, sf, rule=confidence.RULE_V2, *, scores=False):
    a, b = records(spark, sf, "a"), records(spark, sf, "b")
    return confidence.assign(confidence.evidence(a, b, b, rule=rule, markers=(MARKER,), scores=scores), rule)


_CAPS = r"""(SELECT r.doc, CASE WHEN r.failed THEN 0 ELSE least(
  CASE WHEN r.doc IN (SELECT doc FROM leak) THEN 0 ELSE 2 END, CASE WHEN f.found THEN 2 ELSE 0 END, CASE WHEN f.found AND f.page_found <> f.page_claimed THEN 0 ELSE 2 END,
  CASE WHEN ch.n IS NULL THEN 1 WHEN ch.n > 2 THEN 0 WHEN ch.n > 0 THEN 1 ELSE 2 END, CASE WHEN {input} IS NULL THEN 1 WHEN {input} > 2 THEN 0 WHEN {input} > 0 THEN 1 ELSE 2 END,
  CASE WHEN r.limitation IS NOT NULL AND NOT regexp_matches(r.context_text, '(?i)\blimitations?\b|\blimited\b|\bshortcomings?\b|\bdrawbacks?\b|\bcaveats?\b|\bthreats? to (?:the )?validity\b|\bfuture (?:work|research)\b|\bwe acknowledge\b|\bweakness(?:es)?\b') THEN 1 ELSE 2 END) END AS cap
  FROM rec_a r JOIN fid_a f USING (doc) LEFT JOIN ch USING (doc))"""


CONF_SQL = f"""{BOTH}, {fidelity_sql('a')}, {TERM_SQL}, {DIFF_SQL},
ch AS (SELECT doc, count(*) FILTER (WHERE NOT equal) AS n, count(*) FILTER (WHERE field = 'limitation' AND (a IS NULL) <> (b IS NULL)) AS c FROM eq GROUP BY doc),
caps AS {_CAPS},
conf AS (SELECT doc, ['baixa', 'media', 'alta'][cap + 1] AS confidence FROM caps)"""


@query("confidence_levels", CONF_SQL.replace("{input}", "ch.c") + " SELECT doc, confidence FROM conf")
def confidence_levels(spark, sf):
    return _assigned(spark, sf).select("doc", "confidence")


@query("confidence_reasons")
def confidence_reasons(spark, sf):
    return _assigned(spark, sf, scores=True).select("doc", F.array_join("reasons", "; ").alias("reasons"))


@query("confidence_distribution", CONF_SQL.replace("{input}", "ch.c") + " SELECT l.c AS confidence, count(conf.doc) AS n FROM (VALUES ('baixa'), ('media'), ('alta')) l(c) LEFT JOIN conf ON conf.confidence = l.c GROUP BY l.c")
def confidence_distribution(spark, sf):
    return confidence.distribution(_assigned(spark, sf))


@query("not_defensible", CONF_SQL.replace("{input}", "ch.c") + " SELECT doc FROM conf WHERE confidence = 'baixa'")
def not_defensible(spark, sf):
    return confidence.not_defensible(_assigned(spark, sf)).select("doc")


@query("confidence_strict", CONF_SQL.replace("{input}", "ch.n") + " SELECT doc, confidence FROM conf")
def confidence_strict(spark, sf):
    return _assigned(spark, sf, confidence.RULE_V1).select("doc", "confidence")


@query("confidence_by_rule", CONF_SQL.replace("{input}", "ch.c") + ", caps_1 AS " + _CAPS.replace("{input}", "ch.n") + " SELECT conf.doc, ['baixa', 'media', 'alta'][caps_1.cap + 1] AS v1, confidence AS v2 FROM conf JOIN caps_1 USING (doc)")
def confidence_by_rule(spark, sf):
    a, b = records(spark, sf, "a"), records(spark, sf, "b")
    return confidence.by_rule(a, b, b, {"v1": confidence.RULE_V1, "v2": confidence.RULE_V2}, markers=(MARKER,), scores=False)


@query("final_table", CONF_SQL.replace("{input}", "ch.c") + f" SELECT r.doc, coalesce(problem, '{confidence.FAILED_TEXT}') AS problem, coalesce(data, '{confidence.FAILED_TEXT}') AS data, limitation, page::BIGINT AS page, confidence, run_id AS audit_run_id FROM rec_a r JOIN conf USING (doc)")
def final_table(spark, sf):
    return confidence.final_table(_assigned(spark, sf)).select("doc", "problem", "data", "limitation", "page", "confidence", "audit_run_id")


# ---------------------------------------------------------------- cost and report tables
COST_SQL = "input_tokens, output_tokens, input_tokens + output_tokens AS total_tokens, input_tokens / 1000000.0::DOUBLE * 3.0::DOUBLE AS usd_input, output_tokens / 1000000.0::DOUBLE * 15.0::DOUBLE AS usd_output, input_tokens / 1000000.0::DOUBLE * 3.0::DOUBLE + output_tokens / 1000000.0::DOUBLE * 15.0::DOUBLE AS usd_total"


@query("cost_by_run", f"{BOTH}, r AS (SELECT * FROM rec_a UNION ALL SELECT * FROM rec_b), s AS (SELECT run_id, count(*) AS n_calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens FROM r GROUP BY run_id) SELECT run_id, n_calls, {COST_SQL} FROM s")
def cost_by_run(spark, sf):
    return cost.cost(records(spark, sf, "a").unionByName(records(spark, sf, "b")), PRICE, "run_id").drop("premise")


@query("naive_cost", f"WITH s AS (SELECT count(*) * 2 AS n_calls, (sum({TOKENS_SQL.format(x='text')} + 500) * 2)::BIGINT AS input_tokens, count(*) * 2 * 300 AS output_tokens FROM documents) SELECT n_calls, {COST_SQL} FROM s")
def naive_cost(spark, sf):
    return cost.naive_cost(documents(spark, sf), PRICE, calls=2, overhead=500).drop("premise")


NAIVE_SQL = f"""WITH {records_sql('a')}, x AS (SELECT run_id, greatest(0, input_tokens - {TOKENS_SQL.format(x='context_text')} + {TOKENS_SQL.format(x='d.text')}) AS whole, input_tokens, output_tokens FROM rec_a r JOIN documents d ON d.doc_id = r.doc_id),
s AS (SELECT run_id, sum(input_tokens)::BIGINT AS i, sum(whole)::BIGINT AS w, sum(output_tokens)::BIGINT AS o FROM x GROUP BY run_id), u AS (SELECT *, i / 1000000.0::DOUBLE * 3.0::DOUBLE + o / 1000000.0::DOUBLE * 15.0::DOUBLE AS real_usd, w / 1000000.0::DOUBLE * 3.0::DOUBLE + o / 1000000.0::DOUBLE * 15.0::DOUBLE AS naive_usd FROM s)
SELECT run_id, real_usd, naive_usd, naive_usd / real_usd AS ratio, w / i::DOUBLE AS token_ratio, naive_usd - real_usd AS savings_usd, (naive_usd - real_usd) / naive_usd AS savings_share FROM u"""


@query("compare_costs", NAIVE_SQL)
def compare_costs(spark, sf):
    r = records(spark, sf, "a")
    naive = cost.naive_cost_of_records(r, documents(spark, sf), PRICE, "run_id")
    return cost.compare(cost.cost(r, PRICE, "run_id"), naive, "run_id")


def _leaked(spark, sf, run):
    r = records(spark, sf, run)
    rows = stats.audited(r, gold=_gold(spark, sf), leaked=leakage.term_leaks(r, (MARKER,)))
    return rows.join(leakage.leaked_by_doc(leakage.term_leaks(r, (MARKER,))), ["run_id", "doc"], "left")


CASES_SQL = f"{BOTH}, {fidelity_sql('a')}, {fidelity_sql('b')}, {TERM_SQL}, leak_a AS (SELECT DISTINCT doc FROM leak), tb AS (" + " UNION ALL ".join(f"SELECT doc, {c} AS value, context_text FROM rec_b WHERE NOT failed AND {c} IS NOT NULL" for _, c in FIELD_SQL[:6]) + r"), leak_b AS (SELECT DISTINCT doc FROM tb WHERE regexp_matches(value, '(?i)\bthe\b') AND NOT regexp_matches(context_text, '(?i)\bthis\b')), c AS (SELECT r.run_id, r.doc, f.found, l.doc IS NOT NULL AS leaked FROM rec_a r JOIN fid_a f USING (doc) LEFT JOIN leak_a l ON l.doc = r.doc WHERE NOT r.failed UNION ALL SELECT r.run_id, r.doc, f.found, l.doc IS NOT NULL FROM rec_b r JOIN fid_b f USING (doc) LEFT JOIN leak_b l ON l.doc = r.doc WHERE NOT r.failed), k AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY run_id) AS rk FROM c WHERE leaked OR NOT found)"


def _invention_cases(spark, sf):
    return overview.invention_cases(_leaked(spark, sf, "a").unionByName(_leaked(spark, sf, "b"))).select("run_id", "doc", "kind")


@query("invention_cases", CASES_SQL + " SELECT run_id, doc, CASE WHEN leaked AND found THEN 0 WHEN leaked THEN 1 ELSE 2 END AS kind FROM k WHERE rk = 1")
def invention_cases(spark, sf):
    return _invention_cases(spark, sf)


@query(
    "highlights",
    CASES_SQL + ", o AS (SELECT run_id, doc, CASE WHEN leaked AND found THEN 0 WHEN leaked THEN 1 ELSE 2 END AS kind FROM k WHERE rk = 1), p AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY doc) = 1 AS of_kind FROM o) SELECT run_id, doc, kind FROM p ORDER BY CASE WHEN of_kind THEN 1000 + [1, 0, 2][kind + 1] ELSE 2000 END, doc LIMIT 3",
)
def highlights(spark, sf):
    return overview.highlights(_invention_cases(spark, sf), 3)


@query("limitation_outcome", f"{FID} SELECT r.run_id, count(*) AS n, count(*) FILTER (WHERE limitation IS NOT NULL) AS filled, count(*) FILTER (WHERE limitation IS NOT NULL AND found) AS filled_and_found, count(*) - count(*) FILTER (WHERE limitation IS NOT NULL) AS limitation_null FROM rec_a r JOIN fid_a f USING (doc) GROUP BY r.run_id")
def limitation_outcome(spark, sf):
    return overview.limitation_outcome(_audited(spark, sf, "a"), "run_id")


@query(
    "strategy_comparison",
    f"{FID}, {TERM_SQL}, l AS (SELECT doc, bool_or(field = 'limitation') AS lim FROM leak GROUP BY doc) SELECT strategy, count(*) FILTER (WHERE NOT failed) AS cards, count(*) AS n, count(*) FILTER (WHERE found) AS n_found, count(*) FILTER (WHERE found AND page_found = page_claimed) AS n_page_ok, count(l.doc) AS n_leaked, count(*) FILTER (WHERE limitation IS NOT NULL) AS filled, count(*) FILTER (WHERE limitation IS NOT NULL AND NOT coalesce(l.lim, false)) AS legitimate, count(*) FILTER (WHERE limitation IS NOT NULL AND coalesce(l.lim, false)) AS copied, 0::BIGINT AS sentinel, sum(input_tokens)::BIGINT AS input_tokens FROM rec_a r JOIN fid_a f USING (doc) LEFT JOIN l USING (doc) GROUP BY strategy",
)
def strategy_comparison(spark, sf):
    return overview.strategy_comparison(_leaked(spark, sf, "a"), "strategy")


@query("running_totals", f"WITH {PAGES_SQL} SELECT doc, page, (sum(length(text)) OVER (PARTITION BY doc ORDER BY page ROWS UNBOUNDED PRECEDING))::BIGINT AS chars FROM pages_v")
def running_totals(spark, sf):
    order = W.partitionBy("doc").orderBy("page").rowsBetween(W.unboundedPreceding, W.currentRow)
    return pages(spark, sf).select("doc", "page", F.sum(F.char_length("text")).over(order).alias("chars"))
