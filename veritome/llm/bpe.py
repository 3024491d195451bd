"""BPE encoding and decoding by speculate and verify.

Words are proposed as greedy longest matches.  A row of tokens is the true encoding if and
only if every adjacent pair is compatible, that is, if no merge across the seam fires before
both tokens are complete.  The merges of a trained vocabulary fire in order of rank, so the
pieces at a seam are known for every rank: the right edge of the left token and the left edge
of the right token.  Numpy looks up all edge pairs of all adjacent pairs at once; only words
with an incompatible pair are merged exactly, all of them side by side.

Words are encoded once per piece of bounded size and remembered up to a fixed number, so memory
is bounded.

Defined results: null text counts as empty; an empty text has no ids and decodes to the empty
string; the strings of special tokens in a text become their ids, as in the tokenizers
library; ids decode by their tokens joined with one space; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritome.llm.common import table, whole_texts

NEVER = np.iinfo(np.int32).max
MAX_WORDS = 250_000


def _byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in keep}
    out |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in out)}
    return out


class Lookup:
    """Whole-array lookups of non-negative int64 keys: open addressing, a quarter full at most."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (4 * len(keys)).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys, self._values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self._keys[slot[todo]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            took = free[first]
            self._keys[slot[took]], self._values[slot[took]] = keys[took], values[took]
            todo = todo[self._keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + (self._keys[slot[todo]] >= 0)) & self._mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Values; -1 where a key is missing."""
        slot = self._slot(keys)
        found = self._keys[slot]
        out = np.where(found == keys, self._values[slot], -1)
        todo = np.flatnonzero((found != keys) & (found >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self._mask
            found = self._keys[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self._values[slot[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out


class WordBpe:
    """Encoder and decoder for a BPE vocabulary file whose words end in a suffix."""

    def __init__(self, path: str):
        import regex

        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in (self.vocab | self.special).items()}
        self._normalise = self._normaliser(spec["normalizer"])
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._path = path
        pattern = split["pattern"]["Regex"]
        self._pieces = regex.compile(pattern).findall
        self._ascii_pieces = re.compile(pattern.replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9"), re.ASCII).findall
        self._known: set[str] = set()
        self._library = None
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._chars = _byte_chars()
        self.rank: dict[tuple[int, int], int] = {}
        self._result: dict[tuple[int, int], int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            pair = (self.vocab[a], self.vocab[b])
            self.rank.setdefault(pair, r)
            self._result.setdefault(pair, self.vocab[a + b])
        self._prepare()
        #: Words of this worker: their ids as decimals, and decoded.  Emptied when it holds MAX_WORDS.
        self.said: dict[str | int, tuple[str, str]] = {}

    @staticmethod
    def _normaliser(spec: dict) -> Callable[[str], str]:
        import unicodedata

        steps = []
        for n in spec["normalizers"] if spec["type"] == "Sequence" else [spec]:
            if n["type"] == "NFC":
                steps.append(lambda s: s if s.isascii() or unicodedata.is_normalized("NFC", s) else unicodedata.normalize("NFC", s))
            elif n["type"] == "Replace" and (n["pattern"], n["content"]) == ({"Regex": r"\s+"}, " "):
                pass  # words never hold white space, so how much of it parts them makes no difference
            elif n["type"] == "Lowercase":  # character by character: no rule depends on neighbours
                steps.append(lambda s: s.lower() if "Σ" not in s else "".join(map(str.lower, s)))
            else:
                raise ValueError(f"unknown normaliser {n['type']}")

        def run(s: str) -> str:
            for f in steps:
                s = f(s)
            return s

        return run

    def _prepare(self) -> None:
        """Edges of all tokens, reachable tokens as a trie, and the merge table."""
        n = self._span = max(self.token) + 1
        parts: dict[int, tuple[int, int, int]] = {}
        for (a, b), r in self.rank.items():
            t = self._result[a, b]
            if t not in parts:
                parts[t] = (a, b, r)
        # A token is proposed only if merging its own characters makes it.
        self.reachable = {t: i for t, i in self.vocab.items() if i not in parts or self._exact(t) == [i]}
        right, left = [[(i, NEVER)] for i in range(n)], [[(i, NEVER)] for i in range(n)]
        for t, (a, b, r) in sorted(parts.items(), key=lambda x: x[1][2]):
            right[t] = [(t, NEVER), (b, r), *right[b][1:]]
            left[t] = [(t, NEVER), (a, r), *left[a][1:]]
        depth = max(map(len, right + left))
        self._right, self._right_until = (np.full((n, depth), x, np.int64) for x in (-1, -1))
        self._left, self._left_until = (np.full((n, depth), x, np.int64) for x in (-1, -1))
        for edge, until, rows in ((self._right, self._right_until, right), (self._left, self._left_until, left)):
            for i, row in enumerate(rows):
                edge[i, : len(row)], until[i, : len(row)] = zip(*row, strict=True)
        # Rank and result of a merge in one value.
        pairs = np.array([a * n + b for a, b in self.rank], np.int64)
        self._merge = Lookup(pairs, np.array([r * n + self._result[p] for p, r in self.rank.items()], np.int64))
        # Symbols are bytes; the last of a word is 256 higher.
        byte = {c: b for b, c in self._chars.items()}
        self._first = np.array([self.vocab[self._chars[b] + e] for e in ("", self.suffix) for b in range(256)], np.int64)
        edges: dict[int, int] = {}
        accept = [-1]
        for t, i in self.reachable.items():
            ends = bool(self.suffix) and t.endswith(self.suffix) and len(t) > len(self.suffix)
            symbols = [byte.get(c) for c in (t[: -len(self.suffix)] if ends else t)]
            if None in symbols:
                continue
            symbols[-1] += 256 * ends
            state = 0
            for x in symbols:
                to = edges.get(state * 512 + x)
                if to is None:
                    to = edges[state * 512 + x] = len(accept)
                    accept.append(-1)
                state = to
            accept[state] = i
        self._step = Lookup(np.fromiter(edges.keys(), np.int64), np.fromiter(edges.values(), np.int64))
        self._accept = np.array(accept, np.int64)

    def _symbols(self, word: str) -> list[str]:
        """Characters of a word in stand-ins, the suffix on the last."""
        return [*word[:-1], word[-1] + self.suffix]

    def _exact(self, token: str) -> list[int]:
        """Merge by rank, leftmost first.  ``token`` is in stand-ins, with the suffix if it ends a word."""
        ends = bool(self.suffix) and token.endswith(self.suffix) and len(token) > len(self.suffix)
        symbols = self._symbols(token[: -len(self.suffix)]) if ends else [*token]
        ids: list[int | None] = [self.vocab.get(s) for s in symbols]
        if None in ids:
            return []
        after = [*range(1, len(ids)), -1]
        before = [*range(-1, len(ids) - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := self.rank.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self._result[a, b], None
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := self.rank.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [i for i in ids if i is not None]

    def _longest(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token and length of the longest match that starts at each symbol; no token crosses a word's end."""
        n = len(symbols)
        token, length = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        at, state, depth = np.arange(n), np.zeros(n, np.int64), 0
        while len(at):
            state = self._step(state * 512 + symbols[at + depth])
            depth += 1
            on = state >= 0
            at, state = at[on], state[on]
            whole = self._accept[state] >= 0
            token[at[whole]], length[at[whole]] = self._accept[state[whole]], depth
            on = at + depth < n
            at, state = at[on], state[on]
        return token, length

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a and b can stand side by side."""
        ok = np.ones(len(a), bool)
        ra, ua, lb, ub = self._right[a], self._right_until[a], self._left[b], self._left_until[b]
        for i in range(ra.shape[1]):
            for j in range(lb.shape[1]):
                rows = np.flatnonzero(ok & (ra[:, i] >= 0) & (lb[:, j] >= 0))
                if not len(rows):
                    break
                found = self._merge(ra[rows, i] * self._span + lb[rows, j])
                rank = found // self._span
                # On equal ranks the leftmost merge fires first: within a before the seam, the seam before within b.
                ok[rows[(found >= 0) & (rank < ua[rows, i]) & (rank <= ub[rows, j])]] = False
        return ok

    def _merge_all(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many words at once: in each round every word does its merge of least rank, leftmost first.

        Returns the tokens of all words in a row, and their number for each word.
        """
        ids = self._first[symbols]
        word = np.repeat(np.arange(len(sizes)), sizes)
        n = len(ids)
        after = np.r_[np.where(word[1:] == word[:-1], np.arange(1, n), -1), -1]
        before = np.r_[-1, np.where(word[1:] == word[:-1], np.arange(n - 1), -1)]
        none = np.iinfo(np.int64).max

        def found(i: np.ndarray) -> np.ndarray:
            out = np.full(len(i), none)
            has = np.flatnonzero(after[i] >= 0)
            got = self._merge(ids[i[has]] * self._span + ids[after[i[has]]])
            out[has] = np.where(got >= 0, got, none)
            return out

        merge = found(np.arange(n))
        live, starts, sizes = np.arange(len(sizes)), starts.copy(), sizes.copy()
        at = np.arange(n)  # symbols of live words, in a row
        gone = np.zeros(n, bool)
        while len(live):
            least = np.minimum.reduceat(merge[at], starts)
            on = least < none
            if not on.all():  # leave finished words
                at = at[np.repeat(on, sizes)]
                live, sizes, least = live[on], sizes[on], least[on]
                starts = np.cumsum(sizes) - sizes
                if not len(live):
                    break
            hit = np.flatnonzero(merge[at] == np.repeat(least, sizes))
            hit = hit[np.r_[True, word[at[hit[1:]]] != word[at[hit[:-1]]]]]
            i = at[hit]
            j = after[i]
            ids[i] = merge[i] % self._span
            gone[j] = True
            merge[j] = none
            after[i] = after[j]
            k = i[after[i] >= 0]
            before[after[k]] = k
            merge[i] = found(i)
            p = before[i]
            p = p[p >= 0]
            merge[p] = found(p)
        return ids[~gone], np.bincount(word[~gone], minlength=int(word[-1]) + 1)

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Token ids of distinct words: propose, verify, merge what fails."""
        if not words:
            return []
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(sizes)
        symbols = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        symbols[ends - 1] += 256
        token, length = self._longest(symbols)
        # Follow the matches from each word's start.
        at, alive = ends - sizes, np.arange(len(raw))
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        bad = np.zeros(len(raw), bool)
        while len(alive):
            t = token[at]
            taken.append((alive, t))
            stuck = t < 0
            bad[alive[stuck]] = True
            at = at + length[at]
            on = ~stuck & (at < ends[alive])
            at, alive = at[on], alive[on]
        owner, ids = np.concatenate([x[0] for x in taken]), np.concatenate([x[1] for x in taken])
        order = np.argsort(owner, kind="stable")
        owner, ids = owner[order], ids[order]
        seam = np.flatnonzero((owner[1:] == owner[:-1]) & (ids[1:] >= 0) & (ids[:-1] >= 0))
        pairs, which = np.unique(ids[seam] * self._span + ids[seam + 1], return_inverse=True)
        bad[owner[seam[~self.compatible(pairs // self._span, pairs % self._span)[which]]]] = True
        counts = np.bincount(owner, minlength=len(raw))
        flat = ids.tolist()
        stops = np.cumsum(counts)
        out = [tuple(flat[a:b]) for a, b in zip((stops - counts).tolist(), stops.tolist(), strict=True)]
        failed = np.flatnonzero(bad)
        if len(failed):
            own = sizes[failed]
            merged, n = self._merge_all(symbols[np.repeat(bad, sizes)], np.cumsum(own) - own, own)
            flat, stops = merged.tolist(), np.cumsum(n)
            for w, a, b in zip(failed.tolist(), (stops - n).tolist(), stops.tolist(), strict=True):
                out[w] = tuple(flat[a:b])
        return out

    def _split(self, text: str) -> list[str]:
        """Normalised words.

        Letters and numbers are those of the library's Unicode version.  A text with a character
        that Python's own tables don't know, where versions may differ, is split by the library.
        """
        if text.isascii():
            return self._ascii_pieces(self._normalise(text))
        if self._known.issuperset(text):
            return self._pieces(self._normalise(text))
        import unicodedata

        fresh = set(text) - self._known
        newer = {c for c in fresh if unicodedata.category(c) == "Cn"}
        self._known |= fresh - newer
        if not newer:
            return self._pieces(self._normalise(text))
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
        plain = self._library.normalizer.normalize_str(text)
        return [plain[a:b] for _, (a, b) in self._library.pre_tokenizer.pre_tokenize_str(plain)]

    def words(self, texts: list[str]) -> list[list[str | int]]:
        """Words of each text; a special token is its id."""
        out = []
        for t in texts:
            if self._special and "<|" in t and self._special.search(t):
                row: list[str | int] = []
                for part in self._special.split(t):
                    row += [self.special[part]] if part in self.special else self._split(part)
                out.append(row)
            else:
                out.append(self._split(t))
        return out

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Token ids of each text."""
        rows = self.words(texts)
        memo: dict[str | int, tuple[int, ...]] = {i: (i,) for i in self.special.values()}
        new = list({w for r in rows for w in r if type(w) is str})
        memo |= zip(new, self.encode_words(new), strict=True)
        return [[i for w in r for i in memo[w]] for r in rows]

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(self.token[i] for i in ids if i in self.token)


_LOADED: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    """One per worker and file."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): token ids of every whole text, and the text they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for keys, texts in slices(batches):
            ids = tok.encode_batch(texts)
            yield pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.list_(pa.int32())), pa.array(map(tok.decode, ids), pa.string())], ["_id", "ids", "decoded"])

    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text"))
    schema = rows.select("_id", F.array(F.lit(0)).alias("ids"), F.lit("").alias("decoded")).schema
    return whole_texts(rows).mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def slices(batches: Iterator[pa.RecordBatch], max_bytes: int = 1_000_000) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts in pieces of bounded size, so that only one piece at a time becomes Python strings; null texts are empty."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
        at, size = 0, 0
        for i, n in enumerate(sizes.tolist(), 1):
            size += n
            if size >= max_bytes or i == len(sizes):
                yield b.column(0).slice(at, i - at), [x or "" for x in b.column(1).slice(at, i - at).to_pylist()]
                at, size = i, 0


def digest_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of the same encoding, without carrying ids to the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        sha = hashlib.sha256
        for keys, texts in slices(batches):
            rows = tok.words(texts)
            said = tok.said
            if new := {w for r in rows for w in r if w not in said}:
                if len(said) + len(new) > MAX_WORDS:
                    said.clear()
                    new = {w for r in rows for w in r}
                names = [w for w in new if type(w) is str]
                for w, ids in [*zip(names, tok.encode_words(names), strict=True), *((w, (w,)) for w in new if type(w) is int)]:
                    said[w] = (" ".join(map(str, ids)), tok.decode(ids))
            parts = [list(map(said.__getitem__, r)) for r in rows]
            ids, plain = ([" ".join([p[k] for p in r]) for r in parts] for k in (0, 1))
            n = pa.array([x.count(" ") + 1 if x else 0 for x in ids], pa.int64())
            digests = ([sha(x.encode()).hexdigest() for x in col] for col in (ids, plain))
            yield pa.RecordBatch.from_arrays([keys, n, *map(pa.array, digests)], ["_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text"))
    schema = rows.select("_id", F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")).schema
    return whole_texts(rows).mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
