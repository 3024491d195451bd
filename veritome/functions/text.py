"""Native text columns: spaces, lines, sentences, token estimates, labels."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Python's str.isspace characters, as a Java class body.
SPACE = r"\s\x1C-\x1F\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: The same, one by one.
SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Spaces other than the plain one that are layout only.
EXOTIC_SPACES = r"[\t\u00A0\u1680\u2000-\u200A\u202F\u205F\u3000]"
#: Texts of which no character but the tab is an exotic space; anchored, since Java searches many times slower.
_NOT_EXOTIC = r"\A[\x00-\x7F\u00A1-\u167F]*+\z"
PAGE_NUMBER = r"(?i)^(?:page\s+|p\.\s*|-\s*)?\d{1,4}(?:\s*(?:/|of|de)\s*\d{1,4})?(?:\s*-)?$"
SENTENCE_END = rf"(?<=[.!?])[{SPACE}]+(?=[A-Z0-9\"'(\[])|\n[{SPACE}]*\n"


def sub(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(to))


def strip(c: Column) -> Column:
    """Without white space of any kind at either end; only the ends are looked at, by no pattern."""
    return F.btrim(c, F.lit(SPACES))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it occurs."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sub_if(c: Column, told: Callable[[Column], Column], pattern: str, to: str) -> Column:
    """``sub`` for texts that a cheap look doesn't rule out: plain pieces are found many times faster than patterns."""
    return once(c, lambda x: F.when(told(x), sub(x, pattern, to)).otherwise(x))


def _any(x: Column, *pieces: str) -> Column:
    return reduce(or_, (F.contains(x, F.lit(p)) for p in pieces))


def _at_line_ends(x: Column, spaces: str) -> Column:
    return _any(x, *(f"{s}\n" for s in spaces)) | reduce(or_, (F.endswith(x, F.lit(s)) for s in spaces))


def _at_line_starts(x: Column, spaces: str) -> Column:
    return _any(x, *(f"\n{s}" for s in spaces)) | reduce(or_, (F.startswith(x, F.lit(s)) for s in spaces))


def normalize_spaces(c: Column) -> Column:
    """Line ends become \\n, layout spaces become plain ones, lines lose spaces at their ends."""
    c = _sub_if(c, lambda x: _any(x, "\r", "\f"), r"\r\n|\r|\f", "\n")
    c = _sub_if(c, lambda x: _any(x, "\t") | ((F.octet_length(x) != F.char_length(x)) & ~x.rlike(_NOT_EXOTIC) & x.rlike(EXOTIC_SPACES)), EXOTIC_SPACES, " ")
    return _sub_if(_sub_if(c, lambda x: _at_line_ends(x, " "), r"(?dm)(?<! ) +$", ""), lambda x: _at_line_starts(x, " "), r"(?dm)^ +", "")


def collapse_spaces(c: Column) -> Column:
    """Runs of spaces become one, three or more line ends become two."""
    c = _sub_if(_sub_if(c, lambda x: _any(x, "  "), r" {2,}", " "), lambda x: _at_line_ends(x, " \t"), r"(?dm)[ \t]+$", "")
    c = _sub_if(c, lambda x: _at_line_starts(x, " \t"), r"(?dm)^[ \t]+", "")
    return strip(_sub_if(c, lambda x: _any(x, "\n\n\n"), r"\n{3,}", "\n\n"))


def is_page_number(line: Column) -> Column:
    return strip(line).rlike(PAGE_NUMBER)


def _single_spaced(c: Column) -> Column:
    """Runs of white space as plain spaces, none at the ends; what is left there needs no pattern."""
    return F.trim(sub(c, rf"[{SPACE}]+", " "))


def line_key(line: Column) -> Column:
    """What repeated headers and footers have in common: lower case, single spaces, digits masked."""
    return sub(F.lower(_single_spaced(line)), r"\d+", "#")


def normalize(c: Column) -> Column:
    """Lower case with single spaces."""
    return F.lower(_single_spaced(c))


def sentences(c: Column) -> Column:
    """Array of trimmed, non-empty sentences."""
    return F.filter(F.transform(F.split(c, SENTENCE_END, -1), strip), lambda s: s != "")


def approx_tokens(c: Column, chars_per_token: float = 4.0) -> Column:
    """Estimated tokens: characters over ``chars_per_token``, rounded half to even, at least 1 unless empty."""
    if chars_per_token <= 0:
        raise ValueError(f"chars_per_token must be positive, not {chars_per_token}")
    n = F.char_length(c)
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.bround(n / F.lit(float(chars_per_token)), 0))).cast("long")


def rate(part: Column, whole: Column) -> Column:
    """part / whole as a double; 0 if the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def slug(c: Column) -> Column:
    """Safe part of an identifier."""
    return F.coalesce(F.nullif(F.btrim(sub(c, r"[^A-Za-z0-9._\-]+", "-"), F.lit("-")), F.lit("")), F.lit("x"))


def format_temperature(c: Column) -> Column:
    return sub(sub(F.format_string("%.2f", c.cast("double")), r"0+$", ""), r"\.$", ".0")


def short_name(doc: Column) -> Column:
    """File name without extension; of more than three parts the first three."""
    stem = sub(doc, r"\.pdf$", "")
    parts = F.split(stem, "_")
    return F.when(F.size(parts) > 3, F.array_join(F.slice(parts, 1, 3), "_")).otherwise(stem)


def clip(c: Column, n: int = 110) -> Column:
    return F.when(F.char_length(c) > n, F.concat(F.rtrim(F.left(c, F.lit(n - 1))), F.lit("…"))).otherwise(c)


def percent(c: Column, digits: int = 0) -> Column:
    """Share as a percentage with a decimal comma; a dash if null."""
    return F.coalesce(F.concat(F.replace(F.format_string(f"%.{digits}f", c * 100), F.lit("."), F.lit(",")), F.lit("%")), F.lit("—"))


def decimal_comma(c: Column, digits: int = 2) -> Column:
    return F.coalesce(F.replace(F.format_string(f"%.{digits}f", c.cast("double")), F.lit("."), F.lit(",")), F.lit("—"))


def thousands(c: Column) -> Column:
    return F.replace(F.format_number(c, 0), F.lit(","), F.lit("."))


def count_of(share: Column, n: Column) -> Column:
    return F.concat(F.bround(share * n, 0).cast("long").cast("string"), F.lit("/"), n.cast("string"))


def surname(name: Column) -> Column:
    return F.element_at(F.split(strip(name), r"\s+"), -1)


#: Two lists of texts that stand for an absent limitation.
SCHEMA_SENTINELS = (
    "", "null", "none", "n/a", "na", "nenhuma", "não declarada", "nao declarada", "não informado", "nao informado", "não informada",
    "nao informada", "not informed", "not reported", "not stated", "not specified", "not declared", "none declared",
)


def null_if_sentinel(c: Column) -> Column:
    return F.when(F.lower(strip(c)).isin(*SCHEMA_SENTINELS), F.lit(None)).otherwise(c)


def prompt_sha(system: Column, user: Column) -> Column:
    """Twelve hex digits that name a rendered prompt."""
    return F.substring(F.sha2(F.concat(F.coalesce(system, F.lit("None")), F.lit("\n"), user), 256), 1, 12)
