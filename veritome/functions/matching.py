"""Normal form for comparing quotes, and blocks of a rendered context."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that compare equal.
SINGLE_QUOTES = "‘’‚‛′´`"
DOUBLE_QUOTES = "“”„‟″«»"
DASHES = "‐‑‒–—―−﹘"
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"

_SAME = dict.fromkeys(SINGLE_QUOTES, "'") | dict.fromkeys(DOUBLE_QUOTES, '"') | dict.fromkeys(DASHES, "-") | dict.fromkeys(INVISIBLE, "")
_SPECIAL = re.compile(f"[{''.join(_SAME)}]")
_TIGHT = re.compile(r" ?(-) ?| ([.,;:!?)\]}])|([(\[{]) ")
#: What ``_TIGHT`` changes, as plain substrings.
_LOOSE = tuple(f" {c}" for c in "-.,;:!?)]}") + tuple(f"{c} " for c in "-([{")
_MARK = re.compile(r"^\[p\. (\d+)\][ \t]*$", re.MULTILINE)


def match_form(text: str) -> str:
    """Compatibility form, plain quotes and dashes, case folded, single spaces, none around hyphens or inside brackets."""
    flat = _SPECIAL.sub(lambda m: _SAME[m[0]], unicodedata.normalize("NFKC", text)).casefold()
    flat = " ".join(flat.split())
    while any(x in flat for x in _LOOSE):
        flat = _TIGHT.sub(lambda m: m[1] or m[2] or m[3], flat)
    return flat


@F.udf(T.StringType(), useArrow=True)
def match_form_of(text: str | None) -> str | None:
    return None if text is None else match_form(text)


def blocks(context: str) -> list[tuple[int, str]]:
    """(page, text) blocks of a rendered context; text before the first mark has page 0."""
    marks = list(_MARK.finditer(context))
    head = context[: marks[0].start()] if marks else context
    out = [(0, head.strip())] if head.strip() else []
    stops = [m.start() for m in marks[1:]] + [len(context)] * bool(marks)
    return out + [(int(m[1]), context[m.end() : stop].strip()) for m, stop in zip(marks, stops, strict=True)]


def block_array(context: Column) -> Column:
    """The same, natively: array of (ord, page, text)."""
    from veritome.functions.text import strip

    mark = r"(?dm)^\[p\. (\d+)\][ \t]*$"
    texts = F.transform(F.split(context, mark, -1), strip)
    pages = F.concat(F.array(F.lit(0)), F.transform(F.regexp_extract_all(context, F.lit(mark), F.lit(1)), lambda p: p.cast("int")))
    rows = F.zip_with(pages, texts, lambda p, t: F.struct(p.alias("page"), t.alias("text")))
    rows = F.filter(rows, lambda r: (r["page"] > 0) | (r["text"] != ""))
    return F.transform(rows, lambda r, i: F.struct(i.alias("ord"), r["page"].alias("page"), r["text"].alias("text")))
