"""Places in texts as rows, natively: matches of a pattern, headings and the sections under them, sentences around a cue.

Where a pattern matches follows from the lengths of the matches and of what lies between them, summed
up in blocks, so a text is read once and no match is searched for again.  A document's marks meet in
one window of (page, place) rows, never its texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veritome.functions.text import SPACE, strip

#: Matches whose lengths are summed up together.
BLOCK = 32
# Numbers before headings, and how a list of references is headed.
NUMBERING = r"(?:\d{1,2}(?:\.\d{1,2})*\.?|[IVX]{1,5}\.?|[A-H]\.)"
REFERENCES = rf"(?dim)^(?:{NUMBERING}[ \t]+)?(?:references|bibliography)[ \t]*$"
#: A run of characters without sentence marks, and the marks that may end it.
_RUN = r"""[^.!?\n]++(?:[.!?]++["')\]]*+)?"""
#: A sentence's neighbours are taken along as long as the whole has so many characters.
AROUND = 600


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def positions(text: Column, pattern: str) -> Column:
    """Array of (start, end, text) of all matches of ``pattern``, which never matches nothing; null for a null text."""
    found = lambda t: F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    steps = _bound(text, lambda t: F.zip_with(found(t), F.split(t, pattern, -1), lambda m, gap: F.struct(m.alias("text"), F.char_length(gap).alias("gap"), F.char_length(m).alias("size"))))
    add = lambda acc, x: acc + x["gap"] + x["size"]

    def placed(steps: Column) -> Column:
        n_blocks = F.ceil(F.size(steps) / BLOCK).cast("int")
        numbers = F.when(n_blocks > 0, F.sequence(F.lit(0), n_blocks - 1)).otherwise(F.expr("cast(array() as array<int>)"))
        totals = F.transform(numbers, lambda b: F.aggregate(F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0), add))
        before = lambda totals: F.transform(numbers, lambda b: F.aggregate(F.slice(totals, F.lit(1), b), F.lit(0), lambda a, x: a + x))

        def rows(bases: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                block = F.floor(i / BLOCK).cast("int")
                start = F.aggregate(F.slice(steps, block * BLOCK + 1, i - block * BLOCK), F.get(bases, block), add) + x["gap"]
                return F.struct(start.alias("start"), (start + x["size"]).alias("end"), x["text"].alias("text"))

            return F.transform(steps, one)

        return _bound(_bound(totals, before), rows)

    # What lies after the last match has no match of its own.
    return _bound(F.filter(steps, lambda x: x["text"].isNotNull()), placed)


def match_rows(rows: DataFrame, text: str, pattern: str) -> DataFrame:
    """Columns of ``rows`` but ``text``, and (start, end, text) of each match, a row each."""
    kept = [c for c in rows.columns if c != text]
    return rows.select(*kept, F.inline(positions(F.col(text), pattern)))


def headings(pages: DataFrame, sections: Sequence[tuple[str, str]], numbering: str = NUMBERING) -> DataFrame:
    """(doc, page, start, section, rank, label) of lines that head one of ``sections`` (name, words), the first whose words fit.

    After a number a section's words are enough; without one they are followed by a dot, colon, dash or the
    line's end, or by 60 more characters at most without one.  They begin with a capital letter.
    """
    anything = "|".join(words for _, words in sections)
    lines = match_rows(pages.select("doc", "page", "text"), "text", rf"(?dim)^(?:{numbering}[ \t]+)?(?:{anything})[^\n]*+")
    number = F.regexp_extract("text", rf"(?i)^{numbering}[ \t]+", 0)
    split = lines.select("doc", "page", "start", "text", number.alias("_number"), F.expr("substring(text, char_length(_number) + 1)").alias("_rest"))
    tails = {True: r"\b", False: r"(?=[ \t]*(?:[.:—–]|$)|[ \t]+[^.:]{1,60}$)"}
    fits = lambda words, numbered: F.regexp_extract("_rest" if numbered else "text", rf"(?i)^(?:{words}){tails[numbered]}", 0)
    none = F.lit(None).cast("struct<rank:int,section:string,words:string,numbered:boolean>")
    found = none
    for numbered in (False, True):
        for rank, (name, words) in reversed([*enumerate(sections)]):
            own = F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("section"), fits(words, numbered).alias("words"), F.lit(numbered).alias("numbered"))
            fit = (fits(words, numbered) != "") & (F.col("_number") != "" if numbered else F.lit(True))
            found = F.when(fit, own).otherwise(found)
    named = split.withColumn("_found", found).filter(F.col("_found.words").rlike("^[A-Z]"))
    label = F.concat(F.when(F.col("_found.numbered"), F.col("_number")).otherwise(""), F.col("_found.words"))
    return named.select("doc", "page", "start", F.col("_found.section").alias("section"), F.col("_found.rank").alias("rank"), label.alias("label"))


def references(pages: DataFrame, pattern: str = REFERENCES) -> DataFrame:
    """(doc, page, start) of lines that head a list of references."""
    return match_rows(pages.select("doc", "page", "text"), "text", pattern).select("doc", "page", "start")


def section_extents(pages: DataFrame, heads: DataFrame, ends: DataFrame) -> DataFrame:
    """(doc, section, label, head_page, head_start, page, start, stop): what stands under each heading, page by page.

    ``heads`` count up to the document's first of ``ends`` (its references); a section goes on to the next heading
    or end, and on a page after its own it begins after leading white space.
    """
    marks = heads.select("doc", "page", "start", F.struct("section", "label").alias("_head")).unionByName(ends.select("doc", "page", "start").withColumn("_head", F.lit(None)))
    order = W.partitionBy("doc").orderBy("page", "start", F.col("_head").isNull().desc())
    ended = F.max(F.col("_head").isNull()).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    after = F.lead(F.struct("page", "start")).over(order)
    open_ = marks.withColumns({"_ended": ended, "_next": after}).filter("not _ended")
    spans = open_.select(F.col("doc").alias("_doc"), "_head.section", "_head.label", F.col("page").alias("head_page"), F.col("start").alias("head_start"), "_next")
    texts = pages.select("doc", "page", F.char_length("text").alias("_chars"), (F.char_length("text") - F.char_length(F.regexp_replace("text", rf"^[{SPACE}]+", ""))).alias("_blank"))
    under = (F.col("doc") == F.col("_doc")) & (F.col("page") >= F.col("head_page")) & (F.col("_next").isNull() | (F.col("page") <= F.col("_next.page")))
    start = F.when(F.col("page") == F.col("head_page"), F.col("head_start")).otherwise(F.col("_blank"))
    stop = F.when(F.col("page") == F.col("_next.page"), F.col("_next.start")).otherwise(F.col("_chars"))
    out = spans.join(texts, under).select("doc", "section", "label", "head_page", "head_start", "page", start.alias("start"), F.greatest(start, stop).alias("stop"))
    return out


def body(pages: DataFrame, ends: DataFrame) -> DataFrame:
    """(doc, page, text) of pages with text before the first of ``ends``; its own page is cut there."""
    first = ends.groupBy(F.col("doc").alias("_doc")).agg(F.min(F.struct("page", "start")).alias("_end"))
    cut = F.when(F.col("page") == F.col("_end.page"), F.expr("substring(text, 1, _end.start)")).otherwise(F.col("text"))
    kept = pages.select("doc", "page", "text").join(first, F.col("doc") == F.col("_doc"), "left").filter("_end is null or page <= _end.page")
    return kept.select("doc", "page", cut.alias("text")).filter(strip(F.col("text")) != "")


def sentence_windows(pages: DataFrame, cues: str, strong: str, around: int = AROUND) -> DataFrame:
    """(doc, page, start, end, sentence, word, weak): each sentence with a cue, with the sentences before and after it that leave the whole at ``around`` characters.

    A sentence is a run of characters on a line that ends in a sentence mark or with the page; ``sentence`` is where the cue's own begins.  ``word`` is its first cue in lower
    case; ``weak`` says that it has no strong one.  Wholly native, without a shuffle.
    """
    chars = F.char_length("text")
    whole = F.filter(positions(F.col("text"), _RUN), lambda s: (s["text"].rlike(r"""[.!?]["')\]]*$""") | (s["end"] >= F.col("_end"))) & s["text"].rlike(rf"[^{SPACE}]"))
    # A line feed that ends a page comes after its last sentence.
    rows = pages.select("doc", "page", "text", (chars - F.when(F.endswith("text", F.lit("\n")), 1).otherwise(0)).alias("_end")).select("doc", "page", whole.alias("_all"))

    def window(all_: Column) -> Column:
        # Most sentences have no cue: what surrounds one is looked at only where one is.
        def one(i: Column) -> Column:
            s, before, after = F.get(all_, i), F.when(i > 0, F.get(all_, i - 1)), F.get(all_, i + 1)
            low = F.when(s["end"] - before["start"] <= around, before["start"]).otherwise(s["start"])
            high = F.when(after["end"] - low <= around, after["end"]).otherwise(s["end"])
            lead = F.when(s["end"] - before["start"] <= around, before["text"]).otherwise(s["text"])
            blank = F.char_length(lead) - F.char_length(F.regexp_replace(lead, rf"^[{SPACE}]+", ""))
            word = F.lower(F.regexp_extract(s["text"], f"(?i){cues}", 0))
            return F.struct((low + blank).alias("start"), high.alias("end"), s["start"].alias("sentence"), word.alias("word"), (~s["text"].rlike(f"(?i){strong}")).alias("weak"))

        hits = F.filter(F.transform(all_, lambda s, i: F.when(s["text"].rlike(f"(?i){cues}"), i)), lambda i: i.isNotNull())
        return F.transform(hits, one)

    return rows.select("doc", "page", F.inline(_bound(F.col("_all"), window)))
