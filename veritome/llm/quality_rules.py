"""Quality rules: repetition counts and tokeniser fertility.

A public vocabulary with byte fallback reads each text as its words joined by one space and
measures characters per token, the share of byte-fallback tokens and the entropy of the token
distribution.  Text the vocabulary was made for gives long, varied tokens; noise gives short,
repeated or byte tokens.  Bands per language, or per script where the language is unknown,
say which values are kept.  Entropy grows with length, so its band follows the value expected
at the text's number of tokens.

Defined results: null and empty texts have no words and fail the base rule; a null or unknown
language falls back to the script of most letters; repeated rows are judged alike; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritome.llm.bpe import slices, vocabulary
from veritome.llm.common import table, whole_texts

SPACE, SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8


class Band(NamedTuple):
    """Least characters per token, most byte-fallback share, and most entropy below what the length leads to expect.

    Expected entropy of a text of 2**x tokens, in bits: a + b x + c x**2 for x within LENGTHS.
    """

    chars_per_token: float
    byte_share: float
    expected: tuple[float, float, float]
    below: float


#: Fixed values, fitted once to labelled text of each language; bands lie outside all of it.
LENGTHS = (4.0, 13.0)
BANDS: Mapping[str, Band] = {
    "en": Band(1.75, 0.10, (0.727, 1.038, -0.0435), 0.38),
    "de": Band(1.90, 0.10, (1.522, 0.8725, -0.0366), 0.31),
    "fr": Band(1.68, 0.10, (1.932, 0.7808, -0.0322), 0.30),
    "es": Band(1.72, 0.10, (1.038, 0.9643, -0.0404), 0.38),
    "Latin": Band(1.30, 0.25, (0.727, 1.038, -0.0435), 1.2),
    "Other": Band(0.25, 0.95, (0.727, 1.038, -0.0435), 3.0),
}


def in_band(band: Band, tokens: int, per_token: float, byte_share: float, entropy: float) -> bool:
    x = min(max(float(np.log2(max(tokens, 1))), LENGTHS[0]), LENGTHS[1])
    a, b, c = band.expected
    return per_token >= band.chars_per_token and byte_share <= band.byte_share and entropy >= a + b * x + c * x * x - band.below


def repeat_words(words: list[bytes]) -> int:
    """Number of words that stand in a window of WINDOW words found twice or more in the text."""
    n = len(words)
    if n <= WINDOW:
        return 0
    seen: dict[bytes, int] = {}
    number = seen.setdefault
    ids = np.fromiter((number(w, len(seen)) for w in words), np.uint64, n)
    if len(seen) == n:
        return 0
    m = n - WINDOW + 1
    h = np.zeros(m, np.uint64)
    for k in range(WINDOW):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + m] + np.uint64(1)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    maybe = order[np.r_[same, False] | np.r_[False, same]]
    # Hashes only propose; the windows themselves are counted.
    windows, counts = [ids[i : i + WINDOW].tobytes() for i in maybe.tolist()], {}
    for w in windows:
        counts[w] = counts.get(w, 0) + 1
    edge = np.zeros(n + 1, np.int64)
    at = maybe[[counts[w] > 1 for w in windows]]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def script(text: str) -> str:
    """Latin or Other, by most letters."""
    if text.isascii():
        return "Latin"
    letters = [c for c in text if c.isalpha()]
    return "Latin" if 2 * sum(c < "ɐ" or "Ḁ" <= c < "ἀ" for c in letters) >= len(letters) else "Other"


class Fertility:
    """Token measures under a sentencepiece vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n = self.model.vocab_size()
        self.byte = np.array([self.model.is_byte(i) for i in range(self.n)])

    def measure(self, texts: list[str]) -> Iterator[tuple[int, int, float]]:
        """(tokens, byte tokens, entropy in bits) of each text."""
        for ids in self.model.encode(texts, num_threads=1):
            counts = np.bincount(ids, minlength=self.n) if ids else np.zeros(self.n, np.int64)
            used = counts[counts > 0] / max(1, len(ids))
            yield len(ids), int(counts[self.byte].sum()), float(-(used * np.log2(used)).sum())


_LOADED: dict[str, Fertility] = {}


def measure_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", *, bands: Mapping[str, Band] = BANDS) -> DataFrame:
    """Base counts, token measures and the verdict of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fertility = _LOADED[path] = _LOADED.get(path) or Fertility(path)
        for b in batches:
            at = 0
            for keys, texts in slices(iter([b])):
                langs = b.column(2).slice(at, len(texts)).to_pylist()
                at += len(texts)
                rows, plain = [], []
                for t in texts:
                    raw = t.encode()
                    words = raw.split()
                    plain.append(b" ".join(words).decode())
                    chars = len(t) - len(raw) + len(raw.translate(None, SPACE))
                    rows.append((len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), duplicate_lines(t), repeat_words(words)))
                out = []
                for (n, chars, *counts, repeat), lang, text, (tokens, in_bytes, entropy) in zip(rows, langs, plain, fertility.measure(plain), strict=True):
                    failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
                    band = bands.get(lang or "") or bands[script(text)]
                    per_token, share = chars / tokens if tokens else 0.0, in_bytes / tokens if tokens else 0.0
                    kept = not failed and in_band(band, tokens, per_token, share, entropy)
                    out.append((n, chars, *counts, repeat, failed, kept, per_token, share, entropy))
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 3
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["_id", *NAMES])

    lang = docs[lang_col].cast("string") if lang_col else F.lit(None).cast("string")
    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text"), lang.alias("_lang"))
    kinds = ["long"] * 5 + ["boolean"] * 2 + ["double"] * 3
    schema = rows.select("_id", *(F.lit(None).cast(k).alias(n) for n, k in zip(NAMES, kinds, strict=True))).schema
    return whole_texts(rows).mapInArrow(run, schema).withColumnRenamed("_id", id_col)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "chars_per_token", "byte_share", "token_entropy"]


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure_documents(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
