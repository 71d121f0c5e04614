"""Toxic passages by maximum-scoring segments.

*Scores.* Each token has the log-odds of its word between toxic and other texts, or of the longest
of its beginnings that is known, with an informative Dirichlet prior from the counts of both; what says nothing
costs a set amount. *Search.* All maximal segments of positive total are found in one pass over a text's tokens.
*Calibration.* The best totals of texts that are not toxic follow an extreme-value law; its two constants turn a total into the
number of such segments that a text of this length has by chance (E-value), and a logistic curve over the E-values of
the best segment and of all together gives the score.

The model is learnt from a bounded sample of labelled rows (``MOST_TEXTS`` of either label, those of the smallest
hash), so it is small and is sent with the tasks; every text is scored whole.

Defined results. A null or empty text has no passage and gets the score of such a text. A doc_id with several labels counts
as toxic if one of them is 1; null labels and null ids teach nothing. Without labelled rows of both kinds every score is 0. Repeated
rows get equal scores. Columns of the input that have the name of one of the operator's own are replaced.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BYTE_CODE, ROLL, buffers, materialize, mix, slices, spare, without

#: Most texts of either label that the model is learnt from.
MOST_TEXTS = 8000
#: Bytes of the beginnings of words that count beside the words.
PREFIXES = (4, 5, 6)
#: Weight of the prior as a share of all tokens counted; least count of a feature in toxic texts; least z of its log-odds.
PRIOR, LEAST_COUNT, LEAST_Z = 0.02, 4, 3.0
#: What a token that says nothing takes from a segment.
STEP_COST = 0.7
#: A segment is significant if fewer than this many as good come by chance in a text.
SIGNIFICANT = 0.05
THRESHOLD = 0.3

_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclasses.dataclass(frozen=True)
class Model:
    """Log-odds by feature hash (sorted), the extreme-value law, and the logistic curve."""

    codes: np.ndarray
    odds: np.ndarray
    rate: float = 1.0
    scale: float = 1.0
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    blank: bool = False


def tokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, text of each run of letters and digits, and prefix sums of the bytes."""
    part = raw[at[0] : at[-1]]
    edge = at - at[0]
    sums = ROLL.prefix(BYTE_CODE[part])
    if not len(part):
        none = np.zeros(0, np.int64)
        return none, none, none, sums
    solid = _IS_WORD[part]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = edge[(edge > 0) & (edge < len(part))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    lo, hi = np.flatnonzero(first), np.flatnonzero(last) + 1
    return lo, hi, np.searchsorted(edge, lo, side="right") - 1, sums


def features(lo: np.ndarray, hi: np.ndarray, sums: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """From the shortest to the word itself: the tokens that have such a feature, and its hash."""
    out = []
    for n in PREFIXES:
        has = np.flatnonzero(hi - lo > n)
        out.append((has, mix(ROLL.ranges(sums, lo[has], lo[has] + n) + np.uint64(n << 8))))
    out.append((np.arange(len(lo)), mix(ROLL.ranges(sums, lo, hi) + (hi - lo).astype(np.uint64))))
    return out


def segments(values: list[float], gaps: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments over positive items with costs between them: first and last item, total.

    The linear scan of Ruzzo and Tompa; ``gaps[i]`` is what lies before item i.
    """
    stack: list[list] = []  # first, last, total before, total after
    total = 0.0
    for i, v in enumerate(values):
        total -= gaps[i]
        new = [i, i, total, total + v]
        total += v
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= new[2]:
                k -= 1
            if k < 0 or stack[k][3] >= new[3]:
                stack.append(new)
                break
            # The new segment swallows all from the one found on.
            new = [stack[k][0], new[1], stack[k][2], new[3]]
            del stack[k:]
    return [(a, b, after - before) for a, b, before, after in stack]


def token_scores(raw: np.ndarray, at: np.ndarray, model: Model):
    """Starts, ends, texts and scores of the tokens between the offsets."""
    lo, hi, doc, sums = tokens(raw, at)
    score = np.full(len(lo), -STEP_COST)
    if len(model.codes):
        for which, code in features(lo, hi, sums):
            k = np.searchsorted(model.codes, code)
            k[k == len(model.codes)] = 0
            hit = model.codes[k] == code
            score[which[hit]] = model.odds[k[hit]] - STEP_COST
    return lo, hi, doc, score


def passages(raw: np.ndarray, at: np.ndarray, model: Model) -> tuple[list[list[tuple[int, int, float]]], np.ndarray]:
    """Of each text the maximal segments (first byte, end byte, total), and its number of tokens."""
    docs = len(at) - 1
    lo, hi, doc, score = token_scores(raw, at, model)
    count = np.bincount(doc, minlength=docs)
    out: list[list[tuple[int, int, float]]] = [[] for _ in range(docs)]
    edge = at - at[0]
    up = np.flatnonzero(score > 0)
    run = np.concatenate(([0.0], np.cumsum(score)))
    cut = np.searchsorted(doc[up], np.arange(docs + 1))
    for d in np.flatnonzero(np.diff(cut)):
        p = up[cut[d] : cut[d + 1]]
        gaps = np.zeros(len(p))
        gaps[1:] = run[p[:-1] + 1] - run[p[1:]]
        out[d] = [(int(lo[p[a]] - edge[d]), int(hi[p[b]] - edge[d]), t) for a, b, t in segments(score[p].tolist(), gaps.tolist())]
    return out, count


def evidence(model: Model, found: list[tuple[int, int, float]], n: int) -> tuple[float, float, list[float]]:
    """Minus the log of the best segment's E-value, the log of 1 + the sum of those of all segments, and all E-values."""
    e = [model.scale * max(1, n) * math.exp(-min(700.0, model.rate * t)) for _, _, t in found]
    logs = [min(60.0, max(0.0, -math.log(max(x, 1e-300)))) for x in e]
    return max(logs, default=0.0) / 10.0, math.log1p(sum(logs)), e


def null_law(ups: list[float], n: int, totals: list[float]) -> tuple[float, float]:
    """The two constants of the extreme-value law from texts that are not toxic.

    The rate is the root of: the mean of e to the rate times a token's score is 1. The scale
    matches the number of segments of at least 1 that such texts have.
    """
    up = np.array(ups)

    def excess(rate: float) -> float:
        return (n - len(up)) * math.exp(-rate * STEP_COST) + float(np.exp(np.minimum(700.0, rate * up)).sum()) - n

    lo, hi = 0.05, 3.0
    if excess(hi) > 0:
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if excess(mid) < 0 else (lo, mid)
    rate = hi
    return rate, max(1, sum(t >= 1.0 for t in totals)) / (max(1, n) * math.exp(-rate))


def lowered(texts: pa.Array) -> pa.Array:
    """Lower case throughout; null counts as empty."""
    return pc.utf8_lower(pc.fill_null(texts, ""))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) -> feature, and in how many tokens of toxic and of other texts a partition has it."""
    sums: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        label = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        raw, at = buffers(lowered(batch.column(1)))
        for i, j in slices(at):
            lo, hi, doc, pre = tokens(raw, at[i : j + 1])
            toxic = label[i:j][doc]
            for which, code in features(lo, hi, pre):
                keys, inverse = np.unique(code, return_inverse=True)
                sums.append((keys, np.stack([np.bincount(inverse, toxic[which], len(keys)), np.bincount(inverse, 1 - toxic[which], len(keys))])))
    if sums:
        keys, inverse = np.unique(np.concatenate([k for k, _ in sums]), return_inverse=True)
        both = np.concatenate([c for _, c in sums], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(pa.array(np.bincount(inverse, row, len(keys)).astype(np.int64)) for row in both)], ["code", "y", "n"])


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Newton's method with a little decay."""
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (p - y) + 0.05 * w)
    return w


def teachable(doc_id: Column) -> Column:
    """Rows that may teach: the checksum of the id as text leaves a remainder other than 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MOST_TEXTS) -> Model:
    """The model from labelled rows that may teach; three of four of them for the log-odds, the rest for the calibration."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & teachable(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("toxic"))
    order = F.xxhash64(F.col("id").cast("string"))
    # At most `most` ids of either label: two bounded top-k lists.
    picked = known.where("toxic = 1").orderBy(order, "id").limit(most).unionByName(known.where("toxic = 0").orderBy(order, "id").limit(most))
    picked = materialize(picked, "labelled")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")
    rows = materialize(rows.select("id", "toxic", "text"), "examples")
    held = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(1)), F.lit(4)) == 0
    counted = rows.where(~held).select("toxic", "text").mapInArrow(_counts, "code long, y long, n long").groupBy("code").agg(F.sum("y").alias("y"), F.sum("n").alias("n"))
    counted = materialize(counted, "features")
    sums = counted.agg(F.sum("y"), F.sum("n")).first()
    empty = Model(np.zeros(0, np.uint64), np.zeros(0), blank=True)
    if not sums[0] or not sums[1]:
        return empty
    total_y, total_n = float(sums[0]), float(sums[1])
    # The prior of a feature follows its share of all tokens.
    prior = PRIOR * (total_y + total_n)
    alpha = F.lit(PRIOR) * (F.col("y") + F.col("n"))
    a, b = F.col("y") + alpha, F.col("n") + alpha
    odds = F.log(a / (F.lit(total_y + prior) - a)) - F.log(b / (F.lit(total_n + prior) - b))
    z = odds / F.sqrt(1 / a + 1 / b)
    got = counted.where((F.col("y") >= LEAST_COUNT) & (z >= LEAST_Z) & (odds > STEP_COST)).select("code", odds.alias("odds")).toPandas()
    codes = got["code"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(codes)
    model = Model(codes[order], got["odds"].to_numpy()[order])
    sample = rows.where(held).select("toxic", "text").mapInArrow(_best(model), "toxic int, n long, totals array<double>, ups array<double>").toPandas()
    if not len(sample) or sample["toxic"].nunique() < 2:
        return dataclasses.replace(model, curve=(-3.0, 1.0, 1.0))
    clean = sample[sample["toxic"] == 0]
    rate, scale = null_law([v for u in clean["ups"] for v in u], int(clean["n"].sum()), [v for t in clean["totals"] for v in t])
    model = dataclasses.replace(model, rate=rate, scale=scale)
    x = np.array([evidence(model, [(0, 0, v) for v in t], int(n))[:2] for t, n in zip(sample["totals"], sample["n"], strict=True)])
    w = _logistic(x, sample["toxic"].to_numpy(float))
    return dataclasses.replace(model, curve=tuple(float(v) for v in w))


def _best(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = buffers(lowered(batch.column(1)))
            for i, j in slices(at):
                found, count = passages(raw, at[i : j + 1], model)
                _, _, doc, score = token_scores(raw, at[i : j + 1], model)
                up = np.flatnonzero(score > 0)
                ups = np.split(score[up], np.searchsorted(doc[up], np.arange(1, j - i)))
                lists = pa.list_(pa.float64())
                cols = [batch.column(0).slice(i, j - i), pa.array(count.astype(np.int64)), pa.array([[t for _, _, t in f] for f in found], lists), pa.array(ups, lists)]
                yield pa.RecordBatch.from_arrays(cols, ["toxic", "n", "totals", "ups"])

    return run


def score(df: DataFrame, model: Model, text_col: str = "text", with_passages: bool = False) -> DataFrame:
    """``df`` with ``score`` and ``predicted`` (and ``passages``: first byte and end of each significant one in the lower-cased text, total, E-value)."""
    own = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    passage = T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("total", T.DoubleType()), T.StructField("e_value", T.DoubleType())])
    if with_passages:
        own.append(T.StructField("passages", T.ArrayType(passage)))
    base = without(df, *[f.name for f in own if f.name != text_col.lower()])
    where = base.columns.index(text_col)
    schema = T.StructType([*base.schema.fields, *own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c0, c1, c2 = model.curve
        for batch in batches:
            raw, at = buffers(lowered(batch.column(where)))
            for i, j in slices(at):
                found, count = passages(raw, at[i : j + 1], model)
                values, spans = [], []
                for f, n in zip(found, count.tolist(), strict=True):
                    best, all_of, e = evidence(model, f, n)
                    values.append(0.0 if model.blank else 1 / (1 + math.exp(-max(-30.0, min(30.0, c0 + c1 * best + c2 * all_of)))))
                    if with_passages:
                        spans.append([{"start": a, "stop": b, "total": t, "e_value": x} for (a, b, t), x in zip(f, e, strict=True) if x < SIGNIFICANT])
                rows = batch.slice(i, j - i)
                cols = [*rows.columns, pa.array(values, pa.float64()), pa.array([int(v >= THRESHOLD) for v in values], pa.int32())]
                if with_passages:
                    cols.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("total", pa.float64()), ("e_value", pa.float64())]))))
                yield pa.RecordBatch.from_arrays(cols, [f.name for f in schema.fields])

    return base.mapInArrow(run, schema)


def keep(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that aren't toxic, with its columns alone."""
    row, text = spare(df, "_row", "_text")
    held = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text_col]).alias(row), F.col(f"`{text_col}`").alias(text))
    got = score(held, model, text).where("predicted = 0")
    return got.select(*[F.col(text).alias(c) if c == text_col else F.col(row).getField(c).alias(c) for c in df.columns])
