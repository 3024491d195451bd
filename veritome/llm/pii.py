"""Personal data: plain identifiers, and disguised ones by offset-preserving deobfuscation.

Plain e-mail addresses, IP addresses, card and phone numbers are found in the source.  Then
three transducers rewrite the text: homoglyphs and invisible characters to plain ASCII;
spelled digits and, in IP addresses and phone numbers, English numbers to digits; at/dot disguises, where they
form a whole address, to @ and dots.  Addresses are read outwards from each sign for "at", however long they are.  A spelled "at" before a domain with plain dots counts only
after a local part with a dot, digit, hyphen or underscore, and only if the domain is a public
mail host or a word like "mail" or "contact" comes before; "_at_" only before a spelled dot and a common top-level domain.
Each character they write remembers the source span it stands for, so identifiers detected in
the rewritten text map back to exact source offsets.  A span is added if its rewritten form
differs from its source and no plain span covers it.

Every scan is linear in the text, also for long runs of digits or letters.

Defined results: null and empty texts have no spans; offsets are code points, end exclusive;
repeated rows get equal results; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritome.llm.bpe import slices
from veritome.llm.common import table, whole_texts

KINDS = ("email", "ip", "card", "phone")


class Span(NamedTuple):
    start: int
    rank: int
    end: int

    def __str__(self) -> str:
        return f"{KINDS[self.rank]}:{self.start}:{self.end}"


LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
# A match can't begin inside a run of digits that failed from its start, so the lookbehind loses none.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+").finditer
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+").finditer
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").finditer


def _emails(text: str) -> Iterator[Span]:
    """Around each @: the run of local characters before it, the domain after it."""
    done = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL:
            begin -= 1
        m = _DOMAIN(text, at + 1) if begin < at else None
        if m:
            yield Span(begin, 0, m.end())
            done = m.end()
        at = text.find("@", max(done, at + 1))


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def plain_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, by start, then kind."""
    out = list(_emails(text))
    for m in _IP(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append(Span(m.start(), 1, m.end()))
    for m in _CARD(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(Span(m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE(text):
            if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append(Span(m.start(), 3, m.end()))
    out.sort()
    return out


class Written(NamedTuple):
    """A rewritten text; character i stands for source [starts[i], ends[i])."""

    text: str
    starts: array[int]
    ends: array[int]


def rewrite(w: Written, parts: Iterable[tuple[int, int, str]]) -> Written:
    """Replace parts (start, end, new), which are in order; each new character stands for its whole part."""
    out, starts, ends, at = [], array("i"), array("i"), 0
    for a, b, new in parts:
        out.append(w.text[at:a] + new)
        starts += w.starts[at:a] + array("i", [w.starts[a]]) * len(new)
        ends += w.ends[at:a] + array("i", [w.ends[b - 1]]) * len(new)
        at = b
    if not at:
        return w
    return Written("".join(out) + w.text[at:], starts + w.starts[at:], ends + w.ends[at:])


# Look-alikes of ASCII letters, and characters that don't show.
CYRILLIC = ("АВЕКМНОРСТХаеорсухіѕјԁԛԝһ", "ABEKMHOPCTXaeopcyxisjdqwh")
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧορ", "ABEZHIKMNOPTYXop")
SIGNS = ("＠﹫．。․＋﹢－‐‑‒–−", "@@...++------")
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
# Full-width, circled-free digit and letter blocks follow from their first code points.
BLOCKS = ((0xFF10, "0", 10), (0xFF21, "A", 26), (0xFF41, "a", 26), (0x0660, "0", 10), (0x06F0, "0", 10), (0x1D7CE, "0", 10), (0x1D7D8, "0", 10), (0x1D7E2, "0", 10), (0x1D7EC, "0", 10), (0x1D7F6, "0", 10))

HOMOGLYPHS = {a: b for x, y in (CYRILLIC, GREEK, SIGNS) for a, b in zip(x, y, strict=True)}
HOMOGLYPHS |= {chr(first + i): chr(ord(to) + i) for first, to, n in BLOCKS for i in range(n)} | dict.fromkeys(INVISIBLE, "")
_HOMOGLYPH = re.compile("[" + "".join(map(re.escape, HOMOGLYPHS)) + "]")

# Spelled digits, by language.
DIGIT_WORDS = {
    w: str(i)
    for words in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for i, w in enumerate(words.split())
} | {"oh": "0"}
# English numbers from ten, and words that repeat the digit after them.
TEENS = {w: str(i) for i, w in enumerate("ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(), 10)}
TENS = {w: str(10 * i) for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
REPEATS = {"double": 2, "triple": 3}
# Common top-level domains.
TOP_LEVELS = frozenset("com org net edu gov info io co eu de fr es it uk us ch at nl".split())
# Public mail hosts.
MAIL_HOSTS = frozenset("gmail.com googlemail.com yahoo.com hotmail.com outlook.com live.com icloud.com aol.com gmx.de gmx.net web.de proton.me protonmail.com".split())
_WORD = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
_NUMBER = "(?:" + "|".join(sorted([*DIGIT_WORDS, *TEENS, *TENS], key=len, reverse=True)) + ")"
_UNIT = rf"(?:\b(?:(?:{'|'.join(REPEATS)})[ ]{_WORD}|{'|'.join(TENS)}|{_NUMBER})\b|[0-9])"
_SPELLED = re.compile(rf"(?i)(?:(?:\bplus\b|\+)[ ]?)?{_UNIT}(?:[ ,.()/-]{{0,3}}{_UNIT}){{6,}}")
_DOT_WORD = r"(?:[ ]?[\[({<][ ]?(?:dot|punkt|punto|point|\.)[ ]?[\])}>][ ]?|(?<![ ])[ ]++(?:dot|punkt|punto|point)[ ]++|_(?:dot|punkt|punto|point)_)"
_OCTET = rf"(?:[0-9]{{1,3}}|\b{_NUMBER}\b(?:[ ,-]{{1,2}}(?:hundred(?:[ ]and)?|{_NUMBER})\b){{0,3}})"
_IP_DOT = rf"({_DOT_WORD}|\.|[ ]\.[ ])"
_SPELLED_IP = re.compile(rf"(?i)(?<![0-9.])({_OCTET}){_IP_DOT}({_OCTET}){_IP_DOT}({_OCTET}){_IP_DOT}({_OCTET})(?![0-9])")
_DIGIT = re.compile(rf"(?i){_UNIT}")
_OCTET_PART = re.compile(rf"(?i)[0-9]|\b(?:hundred|{_NUMBER})\b")
_AT_SHUT = r"[ ]?[\[({<][ ]?(?:at|a|arroba|@)[ ]?[\])}>][ ]?"
_AT_OPEN = r"(?<![ ])[ ]++(?:at|arroba)[ ]++"
_AT = re.compile(rf"(?i)(?P<shut>{_AT_SHUT})|(?P<open>{_AT_OPEN})|(?P<under>_at_)|(?P<sign>@)")
_LABEL = "[A-Za-z0-9-]++"
_HOST = re.compile(rf"(?i){_LABEL}(?:(?:\.|{_DOT_WORD}){_LABEL})+")
_PROSE = re.compile(r"(?i)(?:the|a|an|this|that|my|your|our|one|each|every)\b").match
_PLAIN_LOCAL = re.compile(r"[A-Za-z0-9_%+-]++(?:\.[A-Za-z0-9_%+-]++)*").fullmatch
_CUE = re.compile(r"(?i)\b(?:e-?mails?|contact|reach|write to)\b(?:[ ](?:me|us|him|her|them|is|to|at|on|address)){0,3}[ :,]*$").search
_DOTS = re.compile(rf"(?i){_DOT_WORD}")


#: Letters that match ASCII ones regardless of case.
_CASED = str.maketrans("\u0130\u0131\u017f\u212a", "iisk")


def _digit(d: str) -> str:
    if d.isdigit():
        return d
    *times, word = d.translate(_CASED).lower().split(" ")
    return DIGIT_WORDS[word] * (REPEATS[times[0]] if times else 1)


def _octet(text: str) -> str:
    """Digits of a number read out digit by digit, in groups (one ninety-two) or in full (one hundred and five)."""
    out, tens, hundred = "", False, False
    for m in _OCTET_PART.finditer(text):
        word = m[0].translate(_CASED).lower()
        if word == "hundred":
            tens, hundred = False, True
            continue
        new = word if word.isdigit() else TEENS.get(word) or TENS.get(word) or DIGIT_WORDS[word]
        if tens and len(new) == 1 and new != "0":
            out = out[:-1] + new
        else:
            out += new.zfill(2) if hundred else new
        tens, hundred = word in TENS, False
    return out + "00" if hundred else out


def _spelled(m: re.Match) -> list[tuple[int, int, str]]:
    units = [*_DIGIT.finditer(m.string, m.start(), m.end())]
    if sum(not x[0].isdigit() for x in units) < 3:
        return []
    sign = "+" if m[0][0] == "+" or m[0][:4].lower() == "plus" else ""
    out, at, tens = [], m.start(), False
    for d in units:
        word = d[0].translate(_CASED).lower()
        one = TEENS.get(word) or TENS.get(word) or _digit(d[0])
        if tens and len(one) == 1 and one != "0" and m.string[at : d.start()] in (" ", "-"):
            start, _, before = out.pop()
            out.append((start, d.end(), before[:-1] + one))  # twenty seven is 27
        else:
            out.append((at, d.end(), sign + one if not out else one))
        at, tens = d.end(), word in TENS
    return out


def _spelled_ip(m: re.Match) -> list[tuple[int, int, str]]:
    dots = [m[g] for g in (2, 4, 6)]
    if " . " in dots and set(dots) != {" . "}:
        return []
    return [(m.start(g), m.end(g), _octet(m[g]) if g % 2 else ".") for g in range(1, 8)]


def _local(text: str, at: int, done: int, dots: dict[int, int]) -> tuple[int, list[tuple[int, int]]]:
    """Where the local part before ``at`` begins, not before ``done``, and its spelled dots; ``dots`` has the starts of dots by their ends."""
    begin, own = at, []
    while True:
        run = begin
        while run > done and text[run - 1] in LOCAL:
            run -= 1
        if run == begin:  # nothing stands before the last dot
            return (own.pop()[1], own) if own else (begin, own)
        start = dots.get(run, -1)
        if start < done:
            return run, own
        own.append((start, run))
        begin = start


def _mails(text: str) -> Iterator[tuple[int, int, str]]:
    """Parts to replace of each disguised address, read outwards from its "at"."""
    dots = {m.end(): m.start() for m in _DOTS.finditer(text)}
    done = 0
    for m in _AT.finditer(text):
        host = _HOST.match(text, m.end()) if m.start() >= done else None
        if not host:
            continue
        spelled = [(d.start(), d.end()) for d in _DOTS.finditer(text, m.end(), host.end())]
        half = m.lastgroup == "open" and not spelled
        if m.lastgroup != "shut" and not half and (not spelled or _PROSE(text, m.end())):
            continue
        if m.lastgroup == "under" and _TOP.search(host[0])[0].lower() not in TOP_LEVELS:
            continue
        begin, own = _local(text, m.start(), done, {} if half else dots)
        if begin == m.start() or (half and not _half_mail(text, begin, m.start(), host[0])):
            continue
        yield from ((a, b, ".") for a, b in reversed(own))
        yield m.start(), m.end(), "@"
        yield from ((a, b, ".") for a, b in spelled)
        done = host.end()


def _half_mail(text: str, begin: int, end: int, host: str) -> bool:
    """Whether a spelled "at" between plain dots is one of an address."""
    local = text[begin:end]
    if not _PLAIN_LOCAL(local) or not re.search("[0-9._-]", local.strip("._-")):
        return False
    return host.lower() in MAIL_HOSTS or bool(host.rpartition(".")[2].islower() and _CUE(text, max(0, begin - 40), begin))


_TOP = re.compile("[A-Za-z0-9-]+$")


# Gates: what every match of the transducer's pattern, or every one that it rewrites, must hold.
_DOT_IN = re.compile(r"(?i)[\[({<][ ]?(?:dot|punkt|punto|point|\.)[ ]?[\])}>]|[ ](?:dot|punkt|punto|point)[ ]").search
_AT_IN = re.compile(r"(?i)[\[({<][ ]?(?:at|a|arroba|@)[ ]?[\])}>]").search
_OCTET_IN = re.compile(rf"(?i)\.(?:{_NUMBER}\b|(?<=[^\W\d_]\.)[0-9])").search
_HALF_IN = re.compile(r"(?i)[ ](?:at|arroba)[ ]+[A-Za-z0-9-]++\.[A-Za-z0-9-]").search
_UNDER_IN = re.compile(r"(?i)_at_[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*_(?:dot|punkt|punto|point)_").search
_SPACED_IN = re.compile(r"[0-9] \. [0-9]").search
_RUNS = re.compile(r"\w+").findall


_NUMBERS = DIGIT_WORDS.keys() | TEENS.keys() | TENS.keys()


def _three_digit_words(text: str) -> bool:
    """Whole words only, so each is a run of word characters; no run spans lines."""
    text, n = text.lower() if text.isascii() else text.translate(_CASED).lower(), 0
    for line in text.split("\n"):
        n += sum(map(_NUMBERS.__contains__, _RUNS(line)))
        if n >= 3:
            return True
    return False


def _each(pattern: re.Pattern, parts: Callable[[re.Match], list[tuple[int, int, str]]]) -> Callable[[str], Iterator[tuple[int, int, str]]]:
    return lambda text: (part for m in pattern.finditer(text) for part in parts(m))


#: Transducers in turn: gate, and the parts of a text that they replace.
TRANSDUCERS = (
    (lambda t: not t.isascii() and _HOMOGLYPH.search(t), _each(_HOMOGLYPH, lambda m: [(m.start(), m.end(), HOMOGLYPHS[m[0]])])),
    (lambda t: _DOT_IN(t) or _OCTET_IN(t) or _SPACED_IN(t), _each(_SPELLED_IP, _spelled_ip)),
    (_three_digit_words, _each(_SPELLED, _spelled)),
    (lambda t: _AT_IN(t) or _DOT_IN(t) or _HALF_IN(t) or _UNDER_IN(t), _mails),
)


def deobfuscate(text: str) -> Written | None:
    """The text as rewritten by all transducers, each gated by what those before it wrote; None if they leave it as it is."""
    w = None
    for gate, parts in TRANSDUCERS:
        now = w.text if w else text
        if gate(now):
            w = rewrite(w or Written(text, array("i", range(len(text))), array("i", range(1, len(text) + 1))), parts(now))
    return None if w is None or w.text == text else w


def find_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(plain spans, all spans), each by start, then kind."""
    base = plain_spans(text)
    w = deobfuscate(text)
    if w is None:
        return base, base
    added = []
    for s in plain_spans(w.text):
        a, b = w.starts[s.start], w.ends[s.end - 1]
        if text[a:b] != w.text[s.start : s.end] and not any(x.start <= a and b <= x.end for x in base):
            added.append(Span(a, s.rank, b))
    return base, sorted(base + added)


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans, base): arrays of (kind, start, end) in every whole text, base a prefix-free flag per span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("disguised", pa.bool_())]))
        for keys, texts in slices(batches):
            rows = []
            for t in texts:
                base, spans = find_spans(t)
                plain = set(base)
                rows.append([{"kind": KINDS[s.rank], "start": s.start, "end": s.end, "disguised": s not in plain} for s in spans])
            yield pa.RecordBatch.from_arrays([keys, pa.array(rows, kind)], ["_id", "spans"])

    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text"))
    schema = rows.select("_id", F.expr("cast(null as array<struct<kind:string,start:int,end:int,disguised:boolean>>)").alias("spans")).schema
    return whole_texts(rows).mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def redact(text: str, marks: dict[str, str] | None = None) -> str:
    """``text`` with every span replaced by its mark; of overlapping spans the first counts."""
    out, at = [], 0
    for s in find_spans(text)[1]:
        if s.start >= at:
            out += [text[at : s.start], (marks or {}).get(KINDS[s.rank], f"<{KINDS[s.rank]}>")]
            at = s.end
    return "".join(out) + text[at:]


EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_documents(table(spark, sf_dir, "documents"))
    label = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda c: F.array_join(F.transform(c, label), ",")
    base = F.filter("spans", lambda s: ~s["disguised"])
    count = lambda k: F.size(F.filter("spans", lambda s: ~s["disguised"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
