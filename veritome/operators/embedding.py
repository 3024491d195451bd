"""Feature-hashing text vectors: no model, no download, the same on every machine."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIM, NGRAMS, MIN_WORD = 512, (3, 5), 4

# Words without weight, English and Portuguese without accents.
STOP_WORDS = frozenset(
    """a an the of and or in on to for by with from is are was were be been this that these those we our it its as at which not can use
    used using than into over under also such
    o os um uma uns umas de do da dos das e ou em no na nos nas para por com que se ao aos este esta estes estas isso isto como foi foram
    ser sao nao mais pelo pela pelos pelas""".split()
)


@lru_cache(maxsize=4096)
def _apart(c: str) -> str:
    return "" if unicodedata.combining(c) else c


def plain_letters(text: str) -> str:
    if text.isascii():
        return text.lower()
    return re.sub(r"[^\x00-\x7f]", lambda m: _apart(m[0]), unicodedata.normalize("NFKD", text.lower()))


def words(text: str) -> Counter[str]:
    found = Counter(re.findall(r"[a-z0-9]+", plain_letters(text)))
    for w in STOP_WORDS & found.keys():
        del found[w]
    return found


def features(text: str) -> Counter[str]:
    """Counts of words and of character n-grams of longer words, framed by < and >."""
    counts = words(text)
    out: Counter[str] = Counter({f"w:{w}": n for w, n in counts.items()})
    for w, n in counts.items():
        if len(w) >= MIN_WORD:
            framed = f"<{w}>"
            for size in range(NGRAMS[0], NGRAMS[1] + 1):
                for i in range(len(framed) - size + 1):
                    out[f"c:{framed[i : i + size]}"] += n
    return out


#: Texts, and characters of theirs, that are taken apart side by side.
TEXTS, CHARS = 64, 1 << 18
# An n-gram's code is exact: its characters as digits from 1, so that shorter ones differ.
_SYMBOLS = np.zeros(256, np.int64)
_SYMBOLS[np.frombuffer(b"<>0123456789abcdefghijklmnopqrstuvwxyz", np.uint8)] = np.arange(1, 39)
_RADIX, _CODE_BITS = 39, 27


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


_CRC = _crc_table()


def _slots(h: np.ndarray, counts: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Slot and weight of features: the CRC's top bit is the sign."""
    return h % dim, (np.where(h >> 31, 1.0, -1.0) * (1.0 + np.log(counts.astype(float)))).astype(np.float32)


def _grams(long: list[str], counts: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, CRC, count) of the distinct n-grams of each text's words, in the order in which ``features`` meets them."""
    buf = np.frombuffer(f"<{'><'.join(long)}>".encode(), np.uint8)
    size = np.fromiter(map(len, long), np.int64, len(long)) + 2
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(long)), size)
    within = np.arange(len(buf)) - start[owner]
    # A word has three times its length in places: its n-grams by size, then by where they begin.
    n_sizes = NGRAMS[1] - NGRAMS[0] + 1
    bits = int(n_sizes * len(buf)).bit_length()
    group = text[owner] << (_CODE_BITS + bits)
    symbols, code, keys = _SYMBOLS[buf], np.zeros(len(buf), np.int64), []
    for k in range(NGRAMS[1]):
        code = code[: len(buf) - k] * _RADIX + symbols[k:]
        if (step := k + 1 - NGRAMS[0]) >= 0:
            at = np.flatnonzero(within[: len(code)] + k < size[owner[: len(code)]])
            word = owner[at]
            keys.append(group[at] | code[at] << bits | (n_sizes * start[word] + step * size[word] + within[at]))
    key = np.sort(np.concatenate(keys))
    place = key & ((1 << bits) - 1)
    first = np.flatnonzero(np.diff(key >> bits, prepend=-1))
    total = np.add.reduceat(counts[owner[place // n_sizes]], first)
    met = np.argsort(place[first])
    place, total = place[first][met], total[met]
    word = owner[place // n_sizes]
    step, at = np.divmod(place - n_sizes * start[word], size[word])
    at += start[word]
    crc = np.full(len(place), crc32(b"c:") ^ 0xFFFFFFFF, np.uint32)
    for k in range(NGRAMS[1]):
        more = step + NGRAMS[0] > k
        byte = buf[np.minimum(at + k, len(buf) - 1)]
        crc = np.where(more, _CRC[(crc ^ byte) & np.uint32(255)] ^ (crc >> np.uint32(8)), crc)
    return text[word], (crc ^ np.uint32(0xFFFFFFFF)).astype(np.int64), total


def _block(texts: Sequence[str], dim: int) -> np.ndarray:
    counted = [words(t) for t in texts]
    text = np.repeat(np.arange(len(texts)), [len(c) for c in counted])
    names = list(chain.from_iterable(counted))
    counts = np.fromiter(chain.from_iterable(c.values() for c in counted), np.int64, len(names))
    out = np.zeros(len(texts) * dim, np.float32)
    if names:
        crcs = np.fromiter(map(crc32, map(str.encode, names), repeat(crc32(b"w:"))), np.int64, len(names))
        slot, weight = _slots(crcs, counts, dim)
        np.add.at(out, text * dim + slot, weight)
        if (long := np.fromiter(map(len, names), np.int64, len(names)) >= MIN_WORD).any():
            own, crcs, counts = _grams([w for w in names if len(w) >= MIN_WORD], counts[long], text[long])
            slot, weight = _slots(crcs, counts, dim)
            np.add.at(out, own * dim + slot, weight)
    out = out.reshape(len(texts), dim)
    for row in out:
        if norm := float(np.linalg.norm(row)):
            row /= norm
    return out


def _blocks(texts: Sequence[str]) -> Iterator[Sequence[str]]:
    first = size = 0
    for i, t in enumerate(texts):
        if i > first and (i - first == TEXTS or size + len(t) > CHARS):
            yield texts[first:i]
            first, size = i, 0
        size += len(t)
    yield texts[first:]


def vectors(texts: Sequence[str], dim: int = DIM) -> np.ndarray:
    """Unit vectors, a row each: each of ``features`` falls in the slot of its CRC, weighted by the logarithm of its count.

    The n-grams of many texts are counted in one sort of exact codes; weights are added in the order of ``features``, so
    that a text has the same vector in whatever company.
    """
    return np.concatenate([_block(b, dim) for b in _blocks(texts)]) if len(texts) else np.zeros((0, dim), np.float32)


def vector(text: str, dim: int = DIM) -> np.ndarray:
    return vectors([text], dim)[0]


def embed(text: Column, dim: int = DIM) -> Column:
    if dim < 8:
        raise ValueError(f"dim must be at least 8, not {dim}")

    def run(texts: pa.Array) -> pa.Array:
        made = [_block(b, dim).ravel() for b in _blocks([t or "" for t in texts.to_pylist()])] if len(texts) else []
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dim), pa.array(np.concatenate(made) if made else [], pa.float32()))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, T.ArrayType(T.FloatType()))(text)


def unit(v: Column) -> Column:
    """A vector scaled to length 1, natively; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return F.when(norm == 0, v).otherwise(F.transform(v, lambda x: (x / norm).cast("float")))


def embed_column(df: DataFrame, text: str = "text", out: str = "vector", dim: int = DIM) -> DataFrame:
    return df.withColumn(out, embed(F.col(text), dim))
