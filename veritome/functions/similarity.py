"""Edit similarity: ratio of the longest common subsequence, whole and in the best window.

The subsequence length is bit-parallel, and all windows asked for are worked out side by side
in one integer.  With a cutoff only candidate windows are asked for: the needle is cut into more pieces than
a window at the cutoff can have edits, so that some must stand in it whole, and near the same diagonal;
an index of the pieces' positions, counted by diagonal, leaves the others out and loses none.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _masks(s: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(s):
        out[c] = out.get(c, 0) | 1 << i
    return out


def _common(masks: dict[str, int], m: int, t: str) -> int:
    """Length of the longest common subsequence of the masked string (of m characters) and t."""
    full = (1 << m) - 1
    v = full
    get = masks.get
    for c in t:
        if hit := get(c):
            u = v & hit
            v = ((v + u) | (v - u)) & full
    return m - v.bit_count()


def ratio(a: str, b: str) -> float:
    """2 x common / (length a + length b); 1 for two empty strings."""
    if not a and not b:
        return 1.0
    if a == b:
        return 1.0
    short, long_ = (a, b) if len(a) <= len(b) else (b, a)
    return 2.0 * _common(_masks(short), len(short), long_) / (len(a) + len(b))


class Window(NamedTuple):
    score: float
    start: int
    end: int


NONE = Window(0.0, 0, 0)


class Text:
    """A text, its characters' codes and how many windows were compared in it."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.codes = _codes(text)
        self.compared = 0

    def __len__(self) -> int:
        return len(self.text)


#: Windows computed at once, so that a big integer stays in the processor's cache.
BLOCK = 4096


def _common_of_windows(needle: str, text: str, first: int, stop: int) -> np.ndarray:
    """Common subsequence lengths of ``needle`` and the windows of its length that start at ``first`` to ``stop`` - 1.

    One big integer holds the column of every window in a lane of its own, and another the
    masks of all characters; shifted by k lanes, that one has each window's k-th character.
    Places outside the text, before it too, match nothing.
    """
    m, n = len(needle), stop - first
    lane = m // 8 + 1  # a bit to spare takes the carry
    row = {c: mask.to_bytes(lane, "little") for c, mask in _masks(needle).items()}
    nothing = bytes(lane)
    chars = b"".join([nothing * max(0, -first), *(row.get(c, nothing) for c in text[max(0, first) : max(0, stop + m - 1)])])
    hits, full = int.from_bytes(chars, "little"), int.from_bytes(((1 << m) - 1).to_bytes(lane, "little") * n, "little")
    v = full
    for _ in range(m):
        u = v & hits
        v = ((v + u) | (v ^ u)) & full
        hits >>= 8 * lane
    left = np.frombuffer(v.to_bytes(n * lane, "little"), np.uint8).reshape(n, lane)
    return m - np.bitwise_count(left).sum(axis=1, dtype=np.int64)


def _pieces(m: int, edits: int) -> tuple[int, int]:
    """(length of a piece, how many must stand in a window whole): the longest of which enough must."""
    options = [(q, m // q - edits) for q in (6, 5, 4, 3, 2, 1)]
    return next((o for o in options if o[1] >= max(3, m // 10)), max(options, key=lambda o: o[1]))


def candidates(needle: str, text: Text, cutoff: float) -> np.ndarray:
    """Places of all windows that may have a ratio of ``cutoff`` or more, ascending."""
    m, n = len(needle), len(text)
    edits = int(2 * m * (1 - cutoff) + 1e-9)
    q, least = _pieces(m, edits)
    if least <= 0:
        return np.arange(1 - m, n)
    # Plain substring tests settle most texts: a window has pieces whole that its text has, too.
    if n < q or sum(needle[i : i + q] in text.text for i in range(0, m - q + 1, q)) < least:
        return np.arange(0)
    prime = np.uint64(0x9E3779B97F4A7C15)

    def grams(codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes) - q + 1, np.uint64)
        for k in range(q):
            out = out * prime + codes[k : len(codes) - q + 1 + k]
        return out * prime

    # Equal grams of two places of the needle count for both; unequal ones that collide only add candidates.
    own = grams(_codes(needle).astype(np.uint64))[::q]
    theirs = grams(text.codes.astype(np.uint64))
    shift = np.uint64(48)
    listed = np.zeros(1 << 16, bool)
    listed[own >> shift] = True
    at = np.flatnonzero(listed[theirs >> shift])
    order = np.argsort(own, kind="stable")
    low, high = (np.searchsorted(own[order], theirs[at], side) for side in ("left", "right"))
    each = high - low
    piece = order[np.repeat(low - np.cumsum(each) + each, each) + np.arange(each.sum())]
    diagonal = np.sort(np.repeat(at, each) - piece * q)
    if len(diagonal) < least:
        return np.arange(0)
    dense = diagonal[least - 1 :] - diagonal[: len(diagonal) - least + 1] <= 2 * edits
    first, last = diagonal[least - 1 :][dense] - edits, diagonal[: len(diagonal) - least + 1][dense] + edits
    # A window that reaches out at the front starts at 0, and is short by as many characters, each an edit.
    first = np.where(first <= 0, np.maximum(1 - m, -edits), first)
    marks = np.zeros(n + m, np.int64)
    inside = (last >= first) & (first < n)
    np.add.at(marks, first[inside] + m - 1, 1)
    np.add.at(marks, np.minimum(last[inside], n - 1) + m, -1)
    return np.flatnonzero(np.cumsum(marks[:-1]) > 0) + 1 - m


def best_window(needle: str, text: str | Text, cutoff: float = 0.0) -> Window:
    """Best ratio of ``needle`` with a window of ``text`` no longer than it; of equals the first.

    Windows are as long as the needle, or shorter at either end of the text.  If no window
    reaches ``cutoff``, the result has score 0.
    """
    text = text if isinstance(text, Text) else Text(text)
    m, n = len(needle), len(text)
    if not m or not n:
        return Window(1.0 if m == n else 0.0, 0, 0)
    if (at := text.text.find(needle)) >= 0:
        return Window(1.0, at, at + m)
    places = candidates(needle, text, cutoff) if cutoff else np.arange(1 - m, n)
    if not len(places):
        return NONE
    common = np.empty(len(places), np.int64)
    for first, stop in _runs(places):
        common[first:stop] = _common_of_windows(needle, text.text, int(places[first]), int(places[stop - 1]) + 1)
    text.compared += len(places)
    starts, ends = np.maximum(places, 0), np.minimum(places + m, n)
    scores = 2.0 * common / (m + ends - starts)
    best = scores.max()
    if best < cutoff:
        return NONE
    top = np.flatnonzero(scores == best)
    i = top[np.argmin(starts[top])]
    return Window(float(best), int(starts[i]), int(ends[i]))


def _runs(places: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of consecutive places, of ``BLOCK`` at most."""
    edges = np.flatnonzero(np.diff(places) > 1) + 1
    for first, stop in zip([0, *edges.tolist()], [*edges.tolist(), len(places)], strict=True):
        yield from ((i, min(i + BLOCK, stop)) for i in range(first, stop, BLOCK))


def partial_ratio(a: str, b: str, cutoff: float = 0.0) -> float:
    """Best window of the longer string for the shorter one; 0 if below ``cutoff``."""
    if len(a) == len(b):
        return max(best_window(a, b, cutoff).score, best_window(b, a, cutoff).score)
    return best_window(*sorted((a, b), key=len), cutoff).score


class _Rows:
    """Columns of many needles at once, a row each, in as many 64-bit words as the longest needs."""

    def __init__(self, needles: Sequence[str], alphabet: np.ndarray) -> None:
        self.sizes = np.array([len(x) for x in needles], np.int64)
        self.words = max(1, -(-int(self.sizes.max(initial=0)) // 64))
        codes = _codes("".join(needles))
        row = np.repeat(np.arange(len(needles)), self.sizes)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        bit = np.uint64(1) << (place % 64).astype(np.uint64)
        # The last character stands for all that the text doesn't have, and for places outside it.
        self.masks = np.zeros((len(alphabet) + 1, self.words, len(needles)), np.uint64)
        at = np.minimum(np.searchsorted(alphabet, codes), len(alphabet) - 1)
        known = alphabet[at] == codes
        np.bitwise_or.at(self.masks, (at[known], place[known] // 64, row[known]), bit[known])
        self.full = np.zeros((self.words, len(needles)), np.uint64)
        np.bitwise_or.at(self.full, (place // 64, row), bit)

    def step(self, v: np.ndarray, at: np.ndarray | int) -> np.ndarray:
        """The next column after a character; bits beyond a needle's end mean nothing."""
        hits = self.masks[at]
        u = v & hits
        added = v + u
        if self.words > 1:
            carry = np.zeros(added[..., 0, :].shape, np.uint64)
            for w in range(self.words):
                over = added[..., w, :] < v[..., w, :]
                added[..., w, :] += carry
                carry = (over | (added[..., w, :] < carry)).astype(np.uint64)
        return added | (v ^ u)

    def common(self, v: np.ndarray) -> np.ndarray:
        return self.sizes - np.bitwise_count(v & self.full).sum(axis=-2, dtype=np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


#: Rows times blocks of text that are worked out at once.
ROWS = 8192


def may_reach(needles: Sequence[str], text: str, cutoff: float, *, whole: bool = True) -> np.ndarray:
    """Which needles may have a ``partial_ratio`` with ``text``, or with ``whole`` a ``ratio``, of ``cutoff`` or more.

    A window has no more in common with a needle than the stretch of text around it, so stretches of
    twice the needles' length, one at each multiple of it, tell for all windows; many needles share a pass.
    Windows shorter than the needle, at the text's ends, and whole texts are worked out exactly.
    """
    out = np.ones(len(needles), bool)
    sizes, n = np.array([len(x) for x in needles], np.int64), len(text)
    if not n:
        return out
    codes = _codes(text)
    alphabet = np.unique(codes)
    at = np.searchsorted(alphabet, codes)
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    first = 0
    while first < len(order):
        # Needles of about a length, so that the longest sets the stride for all.
        most = max(1, ROWS // max(1, n // int(sizes[order[first]])))
        chosen = order[first : first + most]
        chosen = chosen[sizes[chosen] <= sizes[chosen[0]] + 8]
        out[chosen] = _may_reach([needles[i] for i in chosen], at, alphabet, cutoff - 1e-9, whole)
        first += len(chosen)
    return out


def _may_reach(needles: Sequence[str], at: np.ndarray, alphabet: np.ndarray, cutoff: float, whole: bool) -> np.ndarray:
    rows, n = _Rows(needles, alphabet), len(at)
    sizes, longest = rows.sizes, int(rows.sizes.max())
    out, inside = np.zeros(len(needles), bool), sizes < n
    # At the least a window as short as its common characters allow.
    least = np.where(inside, np.inf, cutoff / (2 - cutoff) * n)
    if whole:
        least = np.minimum(least, cutoff * (sizes + n) / 2)
    if (least <= np.minimum(sizes, n)).any():
        v = rows.full.copy()
        for c in at:
            v = rows.step(v, c)
        out |= rows.common(v) >= least
    if not inside.any():
        return out
    starts = np.arange(0, n, longest)
    padded = np.concatenate([at, np.full(2 * longest, len(alphabet))])
    v = np.broadcast_to(rows.full, (len(starts), *rows.full.shape))
    for k in range(2 * longest):
        v = rows.step(v, padded[starts + k])
    most = rows.common(v).max(axis=0)
    out |= inside & (most >= cutoff * sizes)
    open_ = np.flatnonzero(inside & ~out & (most >= cutoff / (2 - cutoff) * sizes))
    if len(open_):
        sizes, rest = sizes[open_], [needles[i] for i in open_]
        for ends, names in ((at, rest), (at[::-1], [x[::-1] for x in rest])):
            around = _Rows(names, alphabet)
            v = around.full.copy()
            for w in range(1, min(longest, n + 1)):
                v = around.step(v, ends[w - 1])
                if w >= cutoff / (2 - cutoff) * sizes.min() - 1:
                    out[open_] |= (w < sizes) & (2 * around.common(v) >= cutoff * (sizes + w))
    return out


@F.udf(T.DoubleType(), useArrow=True)
def _ratio(a: str | None, b: str | None) -> float | None:
    return None if a is None or b is None else ratio(a, b)


def similarity(a: Column, b: Column) -> Column:
    """Ratio of two columns; equal strings never reach Python's arithmetic."""
    return F.when(a == b, F.lit(1.0)).otherwise(_ratio(a, b))
