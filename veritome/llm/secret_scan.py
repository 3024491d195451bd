"""Secret scan: known forms of secrets, and random strings by a battery of tests.

Known forms are matched as such.  Beside them every long token apart from them is a candidate.
A vendor's prefix (``ghp_``) is set aside, the encoding of the rest is inferred from its characters
(hex, base32, base36, base62, base64), and it must have letters and digits or both cases.  Three
tests look at it twice each, as random output of that encoding and as ordinary text in it:

* chi-squared: how uneven the character counts are, against a uniform alphabet, and against the
  share of equal pairs (``TEXT``) in words and identifiers;
* runs: above and below the middle of the alphabet, against independence; and runs of one
  character class (digits, lower, upper case, signs), against their rate in identifiers;
* serial correlation: of neighbouring codes, against none; and of vowels, against words, where
  vowels and consonants take turns.

A token that fails one as random output, at ``LEVEL`` standard scores, is no secret.  The three
scores against ordinary text are added up to one (for hex, whose letters words seldom spell, with
the chance that all letters lie between a and f), and a bound on the normal tail makes it a
p-value.  The false discovery rate is held at ``FDR`` over all candidates of the table: p-values,
weighted by length, are counted in fixed bins, and a step-up rule over the bins gives the line.

Recall on uniform random tokens, alone in their table, 20, 24, 32 and 40 characters: hex 97, 99,
99, 99 %; base36 80, 90, 98, 99; base62 92, 99, 99, 99; base64 86, 95, 98, 99; base32 71, 83, 93,
96.  Of made-up identifiers with digits 0.6 % pass at that most lenient line.

Everything is DataFrame expressions on the row itself: no shuffle, no Python.  Matches are
found by splitting the text at the pattern, and offsets are summed up in pieces, so a text
with many matches stays near linear.  Findings, without texts, are checkpointed once; what
reaches the driver is one count per bin.

Defined results: null and empty texts have no spans; offsets are code points, end exclusive;
repeated rows get equal results; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritome.llm.common import cut, table

# The known forms.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")
MIN_ASSIGNED = 8

LEVEL, FDR = 3.09, 1e-3
#: Ordinary words and identifiers, by encoding: chance that two characters are equal, share of neighbours that differ in class.
TEXT = {"hex": (0.066, 0.1), "base32": (0.066, 0.06), "base36": (0.066, 0.09), "base62": (0.06, 0.2), "base64": (0.055, 0.3), "base64url": (0.055, 0.3)}
#: Correlation of neighbouring vowels in words, and the chance that a letter is one of a to f.
VOWEL_TURNS, HEX_LETTERS = -0.35, 0.32
VENDOR_PREFIX = r"^(?:[A-Za-z]{2,8}[_-]){1,3}(?=[A-Za-z0-9]{16,}$)"
#: Bins of p-values: so many per power of ten, and the most.
BINS, LAST_BIN = 20, 1200

_SPAN = "struct<start:int,rank:int,end:int,text:string>"
_PIECE = 256


def spans(text: Column, pattern: str, rank: int, group: int = 0, least: int = 0) -> Column:
    """Array of (start, rank, end, text) of the matches of ``pattern`` whose ``group`` has ``least`` characters."""
    p, whole = F.lit(pattern), F.lit(0)
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, p, whole)
    value = F.regexp_extract_all(text, p, F.lit(group)) if group else found
    rows = F.zip_with(F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("m"))), value, lambda x, v: F.struct(x["gap"].alias("gap"), x["m"].alias("m"), v.alias("v")))
    rows = F.filter(rows, lambda x: x["m"].isNotNull())
    none, nones = F.expr(f"cast(array() as array<{_SPAN}>)"), F.expr(f"cast(array() as array<array<{_SPAN}>>)")

    def one(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["m"])
        here = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), x["m"].alias("text")))
        return F.struct(end.alias("at"), F.when(F.length(x["v"]) >= least, F.concat(acc["out"], here)).otherwise(acc["out"]).alias("out"))

    def piece(acc: Column, k: Column, rows: Column) -> Column:
        inner = F.aggregate(F.slice(rows, k * _PIECE + 1, F.lit(_PIECE)), F.struct(acc["at"].alias("at"), none.alias("out")), one)
        return F.element_at(F.transform(F.array(inner), lambda i: F.struct(i["at"].alias("at"), F.concat(acc["out"], F.array(i["out"])).alias("out"))), 1)

    def sums(rows: Column) -> Column:
        ks = F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / _PIECE).cast("int"))
        return F.aggregate(ks, F.struct(F.lit(0).alias("at"), nones.alias("out")), lambda acc, k: piece(acc, k, rows), lambda acc: F.flatten(acc["out"]))

    # The rows are bound once, not worked out anew at each use.
    return F.when(text.rlike(pattern), F.element_at(F.transform(F.array(rows), sums), 1)).otherwise(none)


_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Inferred encodings, tried in turn: form, alphabet, number of symbols.
ENCODINGS = (
    ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 16),
    ("base32", r"^[A-Z2-7]+$", _UPPER + "234567", 32),
    ("base36", r"^([0-9a-z]+|[0-9A-Z]+)$", _DIGITS + _LOWER, 36),
    ("base62", r"^[0-9A-Za-z]+$", _UPPER + _LOWER + _DIGITS, 62),
    ("base64", r"^[0-9A-Za-z+/]+$", _UPPER + _LOWER + _DIGITS + "+/", 64),
    ("base64url", r"^[0-9A-Za-z_-]+$", _UPPER + _LOWER + _DIGITS + "-_", 64),
)


def _battery(c: Column) -> Column:
    """Standard scores of a candidate's tests, as a struct with its span; chars, n and k are null without an encoding."""
    body = F.regexp_replace(F.rtrim(c["text"], F.lit("=")), VENDOR_PREFIX, "")
    mixed = (body.rlike("[0-9]") & body.rlike("[A-Za-z]")) | (body.rlike("[A-Z]") & body.rlike("[a-z]"))

    def pick(value: int) -> Column:
        out = F.when(F.lit(False), F.lit(ENCODINGS[0][value]))
        for e in ENCODINGS:
            out = out.when(body.rlike(e[1]), F.lit(e[value]))
        return F.when(mixed, out)

    def prepared(c: Column) -> Column:
        return F.struct(c.alias("span"), body.alias("body"), pick(0).alias("encoding"), pick(2).alias("alphabet"), pick(3).cast("double").alias("k"))

    def coded(c: Column) -> Column:
        small = c["alphabet"].isin(*(e[2] for e in ENCODINGS if e[2] == e[2].lower()))
        chars = F.split(c["body"], "")
        codes = F.transform(chars, lambda x: F.instr(c["alphabet"], F.when(small, F.lower(x)).otherwise(x)).cast("double") - 1)
        kinds = F.transform(chars, lambda x: F.when(x.between("0", "9"), 0).when(x.between("a", "z"), 1).when(x.between("A", "Z"), 2).otherwise(3))
        squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, x: a + F.pow((F.length(c["body"]) - F.length(F.replace(c["body"], x, F.lit("")))).cast("double"), F.lit(2.0)))
        vowels = F.transform(chars, lambda x: F.when(F.instr(F.lit("aeiouAEIOU"), x) > 0, 1.0).otherwise(0.0))
        return F.struct(c["span"].alias("span"), c["encoding"].alias("encoding"), c["k"].alias("k"), F.length(c["body"]).cast("double").alias("n"), codes.alias("x"), kinds.alias("c"), vowels.alias("v"), squares.alias("squares"))

    def summed(c: Column) -> Column:
        n = F.size(c["x"])
        add, half = lambda a, x: a + x, c["k"] / 2
        neighbours = lambda x, f: F.aggregate(F.zip_with(F.slice(x, F.lit(1), n - 1), F.slice(x, F.lit(2), n - 1), f), F.lit(0.0), add)

        def moments(x: Column) -> Column:
            return F.struct(
                (F.aggregate(x, F.lit(0.0), add) / c["n"]).alias("mean"), F.aggregate(x, F.lit(0.0), lambda a, y: a + y * y).alias("xx"),
                neighbours(x, lambda a, b: a * b).alias("xy"), (F.element_at(x, 1) + F.element_at(x, -1)).alias("ends"),
            )

        differ = lambda a, b: F.when(a != b, 1.0).otherwise(0.0)
        return F.struct(
            c["span"].alias("span"), c["encoding"].alias("encoding"), c["k"].alias("k"), c["n"].alias("n"), c["squares"].alias("squares"), moments(c["x"]).alias("x"), moments(c["v"]).alias("v"),
            (neighbours(c["x"], lambda a, b: differ(a < half, b < half)) + 1).alias("runs"),
            F.aggregate(c["x"], F.lit(0.0), lambda a, x: a + F.when(x < half, 1.0).otherwise(0.0)).alias("low"),
            F.aggregate(c["c"], F.lit(0.0), lambda a, x: a + F.when(x > 0, 1.0).otherwise(0.0)).alias("letters"),
            neighbours(c["c"], differ).alias("changes"),
        )

    def correlation(x: Column, n: Column) -> Column:
        """Of neighbours; null if all are equal."""
        var = x["xx"] - n * x["mean"] * x["mean"]
        return F.when(var > 1e-9, (x["xy"] - x["mean"] * (2 * n * x["mean"] - x["ends"]) + (n - 1) * x["mean"] * x["mean"]) / var)

    def as_random(c: Column) -> tuple[Column, Column, Column]:
        """Standard scores of the three tests on uniform independent symbols."""
        n, k, low = c["n"], c["k"], c["low"]
        df, both = k - 1, 2 * low * (n - low)
        chi = k / n * c["squares"] - n
        z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        return z_chi, F.try_divide(c["runs"] - (both / n + 1), F.sqrt(both * (both - n) / (n * n * (n - 1)))), (correlation(c["x"], n) + 1 / n) * F.sqrt(n)

    def as_text(c: Column) -> tuple[Column, Column, Column]:
        """Standard scores of the three tests against words and identifiers; higher is less like them."""
        n = c["n"]
        of = lambda i: F.element_at(F.create_map(*(x for e, values in TEXT.items() for x in (F.lit(e), F.lit(values[i])))), c["encoding"])
        equal, change, pairs = of(0), of(1), n * (n - 1)
        z_chi = (pairs * equal - (c["squares"] - n)) / F.sqrt(2 * pairs * equal * (1 - equal) + pairs * (n - 2) * equal * equal)
        z_runs = (c["changes"] - 0.5 - (n - 1) * change) / F.sqrt((n - 1) * change * (1 - change))
        return z_chi, z_runs, F.coalesce((correlation(c["v"], n) - VOWEL_TURNS) * F.sqrt(n), F.lit(0.0))

    def scored(c: Column) -> Column:
        fits = [F.abs(z) <= LEVEL for z in as_random(c)]
        z_chi, z_runs, z_serial = as_text(c)
        evidence = (z_chi + z_runs + z_serial) / F.sqrt(F.lit(3.0))
        tail = F.exp(-evidence * evidence / 2) / F.greatest(F.lit(2.0), evidence * 2.5066)
        p = F.when(c["k"] <= 16, tail * F.pow(F.lit(HEX_LETTERS), c["letters"])).otherwise(tail)
        p = F.coalesce(F.when(fits[0] & fits[1] & fits[2] & (evidence > 0), p), F.lit(1.0))
        return F.struct(c["span"].alias("span"), c["encoding"].alias("encoding"), p.alias("p"))

    steps = F.transform(F.array(c), prepared)
    for step in (coded, summed, scored):
        steps = F.transform(steps, step)
    return F.element_at(steps, 1)


def _bin(p: Column, length: Column, mean: float) -> Column:
    """Bin of a length-weighted p-value: higher is smaller."""
    weighted = F.least(F.lit(1.0), F.greatest(p, F.lit(1e-300)) * mean / length)
    return F.least(F.lit(LAST_BIN), F.floor(-F.log10(weighted) * BINS)).cast("int")


def _line(counts: Mapping[int, int]) -> int:
    """Step-up rule: the lowest bin at which no more than FDR of the discoveries are expected to be false."""
    total, found, line = sum(counts.values()), 0, LAST_BIN + 1
    for b in sorted(counts, reverse=True):
        found += counts[b]
        if 10 ** (-b / BINS) * total <= FDR * found:
            line = b
    return line


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans): arrays of (start, rank, end), by start, then kind; rank indexes KINDS.

    What is found isn't written anywhere: the checkpoint holds places, lengths and p-values.
    """
    rows = docs.select(docs[id_col].alias("_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_t"))
    t = F.col("_t")
    known = rows.select("_id", F.array_sort(F.concat(spans(t, ASSIGN, 0, 2, MIN_ASSIGNED), spans(t, ACCESS, 1), spans(t, HEX, 2))).alias("base"), spans(t, CANDIDATE, 3).alias("candidates"))
    apart = F.filter("candidates", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    place = lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))
    outcome = lambda c: F.struct(place(c["span"]).alias("span"), F.length(c["span"]["text"]).cast("double").alias("length"), c["p"].alias("p"))
    tested = cut(known.select("_id", F.transform("base", place).alias("base"), F.transform(F.transform(apart, _battery), outcome).alias("tested")))
    each = tested.select(F.explode("tested").alias("c")).select("c.p", "c.length")
    mean = each.agg(F.avg("length")).first()[0] or 1.0
    line = _line({r["b"]: r["n"] for r in each.groupBy(_bin(F.col("p"), F.col("length"), mean).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()})
    random = F.transform(F.filter("tested", lambda c: _bin(c["p"], c["length"], mean) >= line), lambda c: c["span"])
    return tested.select(F.col("_id").alias(id_col), "base", F.array_sort(F.concat("base", random)).alias("spans"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    kinds = F.array(*map(F.lit, KINDS))
    name = lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda c: F.array_join(F.transform(c, name), ",")
    count = lambda r: F.size(F.filter("base", lambda s: s["rank"] == r)).cast("long").alias(f"n_{KINDS[r]}")
    return found.select("doc_id", *map(count, range(3)), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
