"""Quality rules: base counts and the coverage of texts by repeated n-grams and lines.

Word hashes and the hashes of n words in a row come from prefix sums of a polynomial over
uint64 (:class:`~.common.Rolling`), whole batches at a time in numpy; an n-gram that is
found twice or more in its text marks all words of each of its places, and what counts is
the share of the text's characters in marked words. A line counts when an earlier line of
its text is equal.

Defined results. A null or empty text has no words: all counts 0, ``base_failed`` true,
``kept`` false. Coverages of a text without words are 0. Texts are taken whole, a long one as
a slice of its own. Columns of the input with the name of one of the operator's own are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BYTE_CODE, ROLL, buffers, mix, slices, without, words_of

#: The symbols that are counted.
SYMBOLS = "#*$%&|<>"
#: Most share of a text's word characters in n-grams that occur again: n -> share.
COVERAGE = {5: 0.50, 6: 0.48, 7: 0.46, 8: 0.44, 9: 0.42, 10: 0.40}
#: Most share of a text's lines, and of their characters, that repeat an earlier line.
LINE_SHARE, LINE_CHARS = 0.50, 0.30
#: Most symbols a word.
SYMBOL_SHARE = 0.1
LEAST_WORDS = 50
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def _twice(codes: np.ndarray) -> np.ndarray:
    """Which of the codes occur more than once."""
    s = np.sort(codes)
    again = s[1:][s[1:] == s[:-1]]
    if not len(again):
        return np.zeros(len(codes), bool)
    again = again[np.concatenate(([True], again[1:] != again[:-1]))]
    at = np.searchsorted(again, codes)
    at[at == len(again)] = 0
    return again[at] == codes


def _marked(sums: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Words inside an n-gram that its text has twice or more."""
    w = len(doc)
    inside = np.zeros(w + 1, np.int64)
    if w >= n:
        lo = np.flatnonzero(doc[: w - n + 1] == doc[n - 1 :])
        codes = mix(ROLL.ranges(sums, lo, lo + n)) + mix(doc[lo].astype(np.uint64) + np.uint64(1))
        lo = lo[_twice(codes)]
        np.add.at(inside, lo, 1)
        np.add.at(inside, lo + n, -1)
    return np.cumsum(inside[:-1]) > 0


def measure(raw: np.ndarray, at: np.ndarray, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Counts of the texts between the offsets ``at`` of ``raw``."""
    docs = len(at) - 1
    part = raw[at[0] : at[-1]]
    edge = at - at[0]
    lo, hi, doc, codes = words_of(raw, at)

    def per_doc(which: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(which, weights, minlength=docs).astype(np.int64)

    points = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
    chars = points[hi] - points[lo]
    symbols = np.concatenate(([0], np.cumsum(_IS_SYMBOL[part])))
    out = {"n_words": per_doc(doc), "word_chars": per_doc(doc, chars), "n_symbols": symbols[edge[1:]] - symbols[edge[:-1]]}

    # Lines: from each text's start and after each \n to the next \n or the text's end.
    breaks = np.flatnonzero(part == 10)
    starts = np.concatenate((edge[:-1], breaks + 1))
    ends = np.concatenate((breaks, edge[1:]))
    starts.sort()
    ends.sort()
    owner = np.searchsorted(edge[1:], ends, side="left")
    # Empty texts share their offset with a neighbour; such lines have no word and drop out here.
    full = np.searchsorted(lo, ends) > np.searchsorted(lo, starts)
    starts, ends, owner = starts[full], ends[full], owner[full]
    owner = np.searchsorted(edge, starts, side="right") - 1
    sums = ROLL.prefix(BYTE_CODE[part])
    line = ROLL.spans(sums, starts, ends) + mix(owner.astype(np.uint64) + np.uint64(1))
    order = np.argsort(line, kind="stable")
    again = np.zeros(len(line), bool)
    again[order[1:]] = line[order[1:]] == line[order[:-1]]
    size = points[ends] - points[starts]
    out |= {"n_dup_lines": per_doc(owner[again]), "n_lines": per_doc(owner), "line_chars": per_doc(owner, size), "dup_line_chars": per_doc(owner[again], size[again])}

    sums = ROLL.prefix(codes)
    out["n_repeat_words"] = per_doc(doc[_marked(sums, doc, 3)])
    for n in lengths:
        hit = _marked(sums, doc, n)
        out[f"dup_{n}_chars"] = per_doc(doc[hit], chars[hit])
    return out


def measures(df: DataFrame, text_col: str = "text", lengths: tuple[int, ...] = tuple(COVERAGE)) -> DataFrame:
    """``df`` with every count of :func:`measure`, through one pass in numpy."""
    names = [*BASE, "n_lines", "line_chars", "dup_line_chars", *(f"dup_{n}_chars" for n in lengths)]
    base = without(df, *[n for n in names if n.lower() != text_col.lower()])
    schema = T.StructType([*base.schema.fields, *(T.StructField(n, T.LongType()) for n in names)])
    where = base.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = buffers(batch.column(where))
            for i, j in slices(at):
                got = measure(raw, at[i : j + 1], lengths)
                rows = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(got[n], pa.int64()) for n in names)], [*rows.schema.names, *names])

    return base.mapInArrow(run, schema)


def verdicts(df: DataFrame, text_col: str = "text", coverage: dict[int, float] | None = None) -> DataFrame:
    """``df`` with the base counts, the coverages, ``base_failed`` and ``kept``."""
    coverage = COVERAGE if coverage is None else coverage
    got = measures(without(df, "base_failed", "kept", *(f"coverage_{n}" for n in coverage)), text_col, tuple(coverage))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    over = (share("n_dup_lines", "n_lines") > LINE_SHARE) | (share("dup_line_chars", "line_chars") > LINE_CHARS) | (share("n_symbols", "n_words") > SYMBOL_SHARE)
    for n, most in coverage.items():
        over = over | (share(f"dup_{n}_chars", "word_chars") > most)
    got = got.withColumns({f"coverage_{n}": share(f"dup_{n}_chars", "word_chars") for n in coverage} | {"base_failed": failed, "kept": ~failed & ~over})
    return got.drop("n_lines", "line_chars", "dup_line_chars", *(f"dup_{n}_chars" for n in coverage))


def keep(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that the rules keep, with its columns alone."""
    taken = [c for c in df.columns if c != text_col]
    held = df.select(F.struct(*[F.col(f"`{c}`") for c in taken]).alias("__row"), F.col(f"`{text_col}`").alias("__text"))
    got = verdicts(held, "__text").where("kept")
    return got.select(*[F.col("__text").alias(c) if c == text_col else F.col("__row").getField(c).alias(c) for c in df.columns])
