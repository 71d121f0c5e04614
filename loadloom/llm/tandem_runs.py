"""Periodic runs of words, by the linear tandem-repeat method of Gusfield and Stoye.

*Suffix structure.* The words of a slice of texts are numbers, texts parted by numbers of their own. Ranks of all windows of 1, 2, 4, ... words give
the suffix order, whose intervals are the nodes of the suffix tree, and the longest common extension of two places to either side.
*Leftmost-covering squares.* The text is cut into LZ blocks (each the longest stretch that began before, or a new word); around the border of
each block the extensions of every possible root length show the squares that touch it. Every kind of square has its leftmost place in a run of
equal-length squares that begins at one of these.
*Vocabulary.* From each such square the walk goes from rotation to rotation, the suffix link of its node, while the text goes on with the
word that fell away, and notes the node of each. Roots that are powers of shorter ones are left out.
*Occurrences.* The leaves below the noted nodes are all squares of the text; those of one root length at neighbouring places merge into a run.

All steps are taken in numpy for all places of a slice at once. Before them, words are taken out that no repeated window of half the least run covers:
a run, and any longer one that it might be a part of, lies wholly in such windows.

Defined results. A null or empty text has no runs and collapses to the empty string. Runs are reported by start, then period. Texts are taken
whole, a very long one as a slice of its own; equal rows get equal results; an empty table gives none. Columns of the input with the names of the operator's own are replaced.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import mix, slices, without

#: Least words of a run.
LEAST = 12
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


class Suffixes:
    """Ranks of the windows of 2^k symbols at every place, up to the first k at which all differ. The last symbol occurs once."""

    def __init__(self, x: np.ndarray) -> None:
        n = len(x)
        self.n, self.ranks = n, []
        rank = np.unique(x, return_inverse=True)[1].astype(np.int32)
        while True:
            self.ranks.append(rank)
            top = int(rank.max()) + 1
            if top == n:
                break
            w = 1 << (len(self.ranks) - 1)
            key = rank.astype(np.int64) * (top + 1)
            key[: n - w] += rank[w:] + 1
            order = np.argsort(key)
            ahead = key[order]
            new = np.empty(n, np.int32)
            new[order] = np.concatenate(([0], np.cumsum(ahead[1:] != ahead[:-1]))).astype(np.int32)
            rank = new
        self.rank = rank
        self.order = np.empty(n, np.int64)
        self.order[rank] = np.arange(n)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal symbols from the different places i and j on."""
        at, to = i.copy(), j.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            step = (self.ranks[k][at] == self.ranks[k][to]).astype(np.int64) << k
            at += step
            to += step
        return at - i

    def back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal symbols before the different places i and j."""
        at, to = i.copy(), j.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            a, b = at - (1 << k), to - (1 << k)
            ok = (a >= 0) & (b >= 0)
            step = (ok & (self.ranks[k][np.maximum(a, 0)] == self.ranks[k][np.maximum(b, 0)])).astype(np.int64) << k
            at -= step
            to -= step
        return i - at

    def nodes(self, i: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of the suffix order whose suffixes begin as place i does for ``length`` symbols: first, and one past the last."""
        k = np.frexp(length.astype(np.float64))[1] - 1  # the largest 2^k <= length
        tail = length - (1 << k)
        flat = np.concatenate(self.ranks)
        base = k.astype(np.int64) * self.n
        head_of, tail_of = flat[base + i], flat[base + i + tail]

        def begins(place: np.ndarray) -> np.ndarray:
            inside = (place >= 0) & (place < self.n)
            at = self.order[np.where(inside, place, 0)]
            end = np.minimum(at + tail, self.n - 1)
            return inside & (flat[base + at] == head_of) & (flat[base + end] == tail_of)

        own = self.rank[i].astype(np.int64)
        first, last = own.copy(), own.copy()
        for b in range(int(self.n).bit_length() - 1, -1, -1):
            # What lies between is in the interval too, for the order is sorted.
            first -= begins(first - (1 << b)).astype(np.int64) << b
            last += begins(last + (1 << b)).astype(np.int64) << b
        return first, last + 1

    def blocks(self) -> np.ndarray:
        """Starts of the LZ blocks and the end of the text."""
        least = [self.order]  # of windows of the suffix order, the first place
        while 2 << (len(least) - 1) <= self.n:
            w = 1 << (len(least) - 1)
            least.append(np.minimum(least[-1][:-w], least[-1][w:]))
        own = np.arange(self.n)
        left, right = own.copy(), own + 1
        for k in range(len(least) - 1, -1, -1):
            m, w = least[k], 1 << k
            a = left - w
            left -= ((a >= 0) & (m[np.clip(a, 0, len(m) - 1)] > self.order)).astype(np.int64) << k
            right += ((right + w <= self.n) & (m[np.minimum(right, len(m) - 1)] > self.order)).astype(np.int64) << k
        longest = np.zeros(self.n, np.int64)
        for there, ok in ((left - 1, left > 0), (right, right < self.n)):
            which = np.flatnonzero(ok)
            longest[which] = np.maximum(longest[which], self.ahead(self.order[which], self.order[there[which]]))
        step = np.ones(self.n, np.int64)
        step[self.order] = np.maximum(1, longest)
        out, at, step = [], 0, step.tolist()
        while at < self.n:
            out.append(at)
            at += step[at]
        return np.array([*out, self.n])


def _counted(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows repeated ``number`` times: the row, and 0, 1, ... within it."""
    row = np.repeat(np.arange(len(number)), number)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)


def leftmost_covering(s: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """Squares (place, length of the root) from which every kind of square is reached by rotations within its leftmost run."""
    edge = s.blocks()
    size = np.diff(edge)
    found = []
    # Roots of up to a block's length around its end, of up to two blocks' around its start.
    for border, sign, most in ((edge[1:-1], -1, size[:-1]), (edge[:-1], 1, size + np.append(size[1:], 0))):
        row, k = _counted(most)
        k = k + 1
        left = border[row] - k if sign < 0 else border[row]
        right = left + k
        ok = right < s.n
        left, right, k = left[ok], right[ok], k[ok]
        after, before = s.ahead(left, right), s.back(left, right)
        ok = (after + before >= k) & (after > 0)
        found.append((np.maximum(left - before, left - k + 1)[ok], k[ok]))
    place, root = (np.concatenate(x) for x in zip(*found, strict=True))
    key = np.unique(place * (s.n + 1) + root)
    return key // (s.n + 1), key % (s.n + 1)


def _primitive(s: Suffixes, place: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Which roots aren't powers of shorter ones: those without a period that divides their length by a prime."""
    top = int(root.max(initial=1)) + 1
    factor = np.arange(top)
    for p in range(2, int(top**0.5) + 1):
        if factor[p] == p:
            multiples = factor[p * p :: p]
            multiples[multiples == np.arange(p * p, top, p)] = p
    ok, left = np.ones(len(root), bool), root.copy()
    while len(which := np.flatnonzero(left > 1)):
        p = factor[left[which]]
        period = root[which] // p
        ok[which] &= s.ahead(place[which], place[which] + period) < root[which] - period
        left[which] //= p
    return ok


def vocabulary(s: Suffixes, place: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes (first, end) and root lengths of all kinds of squares with primitive roots, each once, by walks from a covering set."""
    ok = _primitive(s, place, root)
    place, root = place[ok], root[ok]
    # The square goes on turning while the text repeats what is a root back; after as many turns as its root is long it is itself again.
    turns = np.minimum(s.ahead(place, place + root) - root, root - 1)
    row, turn = _counted(turns + 1)
    first, end = s.nodes(place[row] + turn, 2 * root[row])
    _, once = np.unique(first * (s.n + 1) + root[row], return_index=True)
    return first[once], end[once], root[row][once]


def runs_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of every maximal repetition of at least two periods; the last symbol of x occurs once."""
    none = np.zeros(0, np.int64)
    if len(x) < 2:
        return none, none, none
    s = Suffixes(x)
    place, root = leftmost_covering(s)
    if not len(place):
        return none, none, none
    first, end, root = vocabulary(s, place, root)
    row, leaf = _counted(end - first)
    key = np.sort(root[row] * (s.n + 1) + s.order[first[row] + leaf])
    begins = np.concatenate(([True], np.diff(key) > 1))
    ends = np.concatenate((begins[1:], [True]))
    period, start = key[begins] // (s.n + 1), key[begins] % (s.n + 1)
    return start, key[ends] % (s.n + 1) - start + 2 * period, period


def _covered(ids: np.ndarray, doc: np.ndarray, reach: int) -> np.ndarray:
    """Words inside a window of ``reach`` words that its text has twice or more (or, for a clash of hashes, that it might have)."""
    n = len(ids)
    inside = np.zeros(n + 1, np.int64)
    if n > reach:
        code = mix(doc[: n - reach + 1].astype(np.uint64) + np.uint64(1))
        for i in range(reach):
            code = mix(code + ids[i : n - reach + 1 + i].astype(np.uint64))
        at = np.flatnonzero(doc[: n - reach + 1] == doc[reach - 1 :])
        order = at[np.argsort(code[at])]
        same = code[order[1:]] == code[order[:-1]]
        again = order[np.concatenate((same, [False])) | np.concatenate(([False], same))] if len(order) else order
        np.add.at(inside, again, 1)
        np.add.at(inside, again + reach, -1)
    return np.cumsum(inside[:-1]) > 0


def find(ids: np.ndarray, doc: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of the texts whose words have the numbers ``ids``: place in ``ids``, length, period, by place and period."""
    kept = np.flatnonzero(_covered(ids, doc, least // 2))
    if not len(kept):
        none = np.zeros(0, np.int64)
        return none, none, none
    torn = np.concatenate(([False], (np.diff(kept) > 1) | (np.diff(doc[kept]) != 0)))
    at = np.arange(len(kept)) + np.cumsum(torn)
    x = int(ids.max()) + 1 + np.arange(at[-1] + 2)  # a number of its own between pieces and at the end
    x[at] = ids[kept]
    start, length, period = runs_of(x)
    ok = length >= least
    back = np.zeros(len(x), np.int64)
    back[at] = kept
    start, length, period = back[start[ok]], length[ok], period[ok]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def analyse(texts: list[str | None], least: int = LEAST) -> list[tuple[np.ndarray, str]]:
    """Of each text its runs (rows of start, length, period, in words) and the text without what its runs repeat."""
    number: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
    words = [(t or "").encode().split() for t in texts]  # bytes part at [\x20\x09-\x0D] alone
    size = np.array([len(w) for w in words])
    ids = np.fromiter(map(number.__getitem__, itertools.chain.from_iterable(words)), np.int64, int(size.sum()))
    doc = np.repeat(np.arange(len(texts)), size)
    start, length, period = find(ids, doc, least)
    again = np.zeros(len(ids) + 1, np.int64)
    np.add.at(again, start + period, 1)
    np.add.at(again, start + length, -1)
    keep = np.cumsum(again[:-1]) == 0
    edge = np.concatenate(([0], np.cumsum(size)))
    cut = np.searchsorted(start, edge)
    out = []
    for d, own in enumerate(words):
        lo, hi = cut[d], cut[d + 1]
        if hi > lo:
            own = itertools.compress(own, keep[edge[d] : edge[d + 1]])
        out.append((np.stack((start[lo:hi] - edge[d], length[lo:hi], period[lo:hi]), 1), b" ".join(own).decode()))
    return out


def collapse(df: DataFrame, text_col: str = "text", least: int = LEAST, carry: bool = True) -> DataFrame:
    """``df`` with ``runs`` (start, length, period in words) and ``collapsed``: its words, without those that a run repeats after its first period, joined by a space.

    ``carry=False`` leaves the text itself out.
    """
    own = [n for n in ("runs", "collapsed") if n.lower() != text_col.lower()]
    base = without(df, *own)
    where = base.columns.index(text_col)
    kept = [i for i in range(len(base.columns)) if carry or i != where]
    schema = T.StructType([*(base.schema.fields[i] for i in kept), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in RUN.names]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(where)
            sizes = np.concatenate(([0], np.cumsum([0 if v is None else v for v in pc.binary_length(column).to_pylist()]))).astype(np.int64)
            for i, j in slices(sizes):
                got = analyse(column.slice(i, j - i).to_pylist(), least)
                flat = np.concatenate([g[0] for g in got])
                offsets = np.concatenate(([0], np.cumsum([len(g[0]) for g in got]))).astype(np.int32)
                values = pa.StructArray.from_arrays([pa.array(flat[:, c], pa.int64()) for c in range(3)], RUN.names)
                rows = batch.slice(i, j - i)
                new = [pa.ListArray.from_arrays(pa.array(offsets), values).cast(kind), pa.array([g[1] for g in got], pa.string())]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), *new], schema.names)

    return base.mapInArrow(run, schema)
