"""Languages of texts and of their spans: script ranges, scores of words, Viterbi with a price for switching.

*Scores.* A word (a run of letters and marks; four signs at most in scripts that part no words) has for each language the sum of the
log-odds of its hashed n-grams of 1 to 4 signs and of itself, against the mean of all languages. The counts are those of every row that may
teach. *Scripts.* The range of a word's first sign names its script, and only languages that are written in it with at least SCRIPT_SHARE of their words are
candidates for the word; if none is, all are. *Spans.* The labelling of a text's words with the greatest total, each change of language costing SWITCH, is found by
Viterbi's recursion: in blocks of WIDTH words all at once, whose transfer tables are then chained, so that long texts take no loop over their words. Scores are
whole numbers, so the result doesn't depend on how rows are dealt.

The language with the most letters in its spans is the text's. Its score is its share of the letters times a logistic curve of its lead in the whole text.

Defined results. A null text and one without letters are ``und`` with score 0, and so is every text if nothing was learnt. A null language or id teaches nothing. Ties
go to the language that comes first by name. Over MOST_LANGUAGES languages are refused with an error, for the model goes to every task. Texts are taken whole. Columns of the input with
the names of the operator's own are replaced; an empty table gives none.
"""

from __future__ import annotations

import dataclasses
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Shelf, mix, slices, without

BITS, ORDERS = 15, (1, 2, 3, 4)
BUCKETS = 1 << BITS
MOST_LANGUAGES = 256
#: Least share of a language's words in a script that makes it a candidate there.
SCRIPT_SHARE = 0.005
#: Scores count in thousandths: the most that one word says, the price of a change of language, the lead that counts as one step of the curve.
UNIT, MOST_SCORE, SWITCH, LEAD = 1000, 8_000, 6_000, 4_000
#: What is added to every count.
SMOOTH = 0.5
#: Words of a block; table cells that are worked on at once; words kept with their scores.
WIDTH, CELLS, CACHED = 64, 2_000_000, 200_000
UNKNOWN = "und"
#: First code points of script ranges and the script from there on (0: Latin and all else).
SCRIPTS = (
    (0x0000, 0), (0x0370, 1), (0x0400, 2), (0x0530, 3), (0x0590, 4), (0x0600, 5), (0x0900, 6), (0x0980, 7), (0x0A00, 8), (0x0A80, 9), (0x0B00, 10),
    (0x0B80, 11), (0x0C00, 12), (0x0C80, 13), (0x0D00, 14), (0x0D80, 15), (0x0E00, 16), (0x0E80, 17), (0x0F00, 18), (0x1000, 19), (0x10A0, 20), (0x1100, 21),
    (0x1200, 22), (0x1780, 23), (0x1E00, 0), (0x1F00, 1), (0x2000, 0), (0x3040, 24), (0x3100, 25), (0xAC00, 21), (0xD7B0, 0), (0xF900, 25), (0xFB00, 0), (0x20000, 25), (0x30000, 0),
)
_FIRST, _SCRIPT = (np.array(x) for x in zip(*SCRIPTS, strict=True))
NUMBER_OF_SCRIPTS = int(_SCRIPT.max()) + 1
_WORD = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]{1,4}|[[\p{L}\p{M}]--[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]]+", regex.V1)
_LETTER = regex.compile(r"\p{L}")
#: Texts without such signs need neither marks nor unspaced scripts looked for: the plain pattern finds the same words.
_RARE = re.compile("[^\0-\u02ff\u1e00-\u1eff\u2000-\u206f\u20a0-\u20bf]")
_PLAIN = re.compile(r"[^\W\d_\u00b2\u00b3\u00b9\u00bc-\u00be]+")


@dataclasses.dataclass(frozen=True)
class Model:
    """Languages by name, for each of them the score of each bucket, and which of them are candidates for each script."""

    languages: tuple[str, ...]
    odds: np.ndarray
    candidates: np.ndarray


def words_of(text: str | None) -> list[str]:
    lowered = (text or "").lower()
    return (_WORD if _RARE.search(lowered) else _PLAIN).findall(lowered)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The word of each feature, the feature's bucket; and each word's script."""
    signs = np.frombuffer("\0".join(["", *words, ""]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    edge = signs == 0
    word = np.cumsum(edge) - 1
    place = np.arange(len(signs)) - np.flatnonzero(edge)[word]
    starts = np.flatnonzero(edge)[:-1]
    owners, codes = [np.arange(len(words))], [mix(np.add.reduceat(mix(signs + (place.astype(np.uint64) << np.uint64(32))), starts)) if len(words) else np.zeros(0, np.uint64)]
    code, inner = mix(signs), ~edge
    for n in ORDERS:
        if n > 1:
            code = mix(code[:-1] * np.uint64(3) + signs[n - 1 :])
        # Edges may stand at both ends of a window (of one sign: nowhere), and not within it.
        ok = inner if n == 1 else np.ones(len(code), bool) if n == 2 else ok[: len(code)] & inner[n - 2 : n - 2 + len(code)]
        at = np.flatnonzero(ok)
        if n == 2:
            at = at[at < len(signs) - 1]
        owners.append(word[at])
        codes.append(mix(code[at] + np.uint64(n)))
    script = _SCRIPT[np.searchsorted(_FIRST, signs[starts + 1].astype(np.int64), side="right") - 1] if len(words) else np.zeros(0, np.int64)
    return np.concatenate(owners), (np.concatenate(codes) >> np.uint64(64 - BITS)).astype(np.int64), script


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> what a partition has of each bucket in each language; scripts count from BUCKETS on."""
    words: dict[str, Counter] = {}
    sums: dict[str, np.ndarray] = {}

    def flush() -> None:
        for lang, seen in words.items():
            own = sums.setdefault(lang, np.zeros(BUCKETS + NUMBER_OF_SCRIPTS, np.int64))
            times = np.fromiter(seen.values(), np.int64, len(seen))
            word, bucket, script = features(list(seen))
            own += np.bincount(np.concatenate((bucket, BUCKETS + script)), np.concatenate((times[word], times)), len(own)).astype(np.int64)
        words.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, words.values())) > CACHED:
                flush()
    flush()
    for lang, own in sums.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])], ["lang", "bucket", "n"])


def teachable(doc_id: Column) -> Column:
    """Rows that may teach: the checksum of the id as text leaves a remainder other than 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model from every row of ``docs`` with a text and a language."""
    shelf = Shelf(docs.sparkSession)
    rows = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text")).where("lang is not null and text is not null")
    counted = shelf.put(rows.mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "languages")
    number = counted.select("lang").distinct().count()
    if number > MOST_LANGUAGES:
        shelf.clear()
        raise ValueError(f"{number} languages; at most {MOST_LANGUAGES} are told apart")
    got = counted.toPandas()  # at most MOST_LANGUAGES times the buckets
    shelf.clear()
    return model_of(got["lang"].tolist(), got["bucket"].to_numpy(np.int64), got["n"].to_numpy(np.int64))


def model_of(lang: list[str], bucket: np.ndarray, n: np.ndarray) -> Model:
    names = sorted(set(lang))
    counts = np.zeros((BUCKETS + NUMBER_OF_SCRIPTS, len(names)))
    order = {name: i for i, name in enumerate(names)}
    np.add.at(counts, (bucket, np.array([order[x] for x in lang], np.int64)), n)
    grams, scripts = counts[:BUCKETS] + SMOOTH, counts[BUCKETS:]
    share = grams / grams.sum(axis=0) if names else grams
    # Windows of 1 to 4 signs overlap, so each tells a part of the log-odds.
    odds = np.log(share / share.mean(axis=1, keepdims=True)) / len(ORDERS) if names else share
    written = scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=0))
    written[~written.any(axis=1)] = True
    return Model(tuple(names), np.ascontiguousarray(odds.T, np.float32), written)


class Lexicon:
    """Scores of the words that a task has met, and their letters; forgotten when they grow too many."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.languages)), np.int32)
        self.letters = np.zeros(0, np.int64)

    def numbers(self, texts: list[list[str]]) -> np.ndarray:
        if len(self.number) > CACHED:
            self.forget()
        new = [w for w in dict.fromkeys(itertools.chain.from_iterable(texts)) if w not in self.number]
        if new:
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            self.scores = np.concatenate((self.scores, self._score(new)))
            self.letters = np.concatenate((self.letters, [len(w) if w.isalpha() else len(_LETTER.findall(w)) for w in new]))
        return np.fromiter(map(self.number.__getitem__, itertools.chain.from_iterable(texts)), np.int64)

    def _score(self, words: list[str]) -> np.ndarray:
        word, bucket, script = features(words)
        sums = np.stack([np.bincount(word, odds[bucket], len(words)) for odds in self.model.odds], 1)
        out = np.clip(np.rint(sums * UNIT), -MOST_SCORE, MOST_SCORE).astype(np.int32)
        out[~self.model.candidates[script]] = -MOST_SCORE
        return out


def viterbi(scores: np.ndarray, edge: np.ndarray, switch: int = SWITCH, width: int = WIDTH) -> np.ndarray:
    """The best labels of the rows of ``scores``; rows edge[d] to edge[d + 1] are one text, a change of label costs ``switch`` > 0. Staying is preferred to an equal change, then the smaller label."""
    size = np.diff(edge)
    count = -(-size // width)
    first = np.cumsum(count) - count
    total, labels = int(count.sum()), scores.shape[1]
    out = np.zeros(len(scores), np.int64)
    if not total:
        return out
    doc = np.repeat(np.arange(len(size)), count)
    row = (edge[:-1][doc] + (np.arange(total) - first[doc]) * width)[:, None] + np.arange(width)
    inside = row < edge[1:][doc][:, None]
    s = np.where(inside[:, :, None], scores[np.where(inside, row, 0)], 0).astype(np.int64)
    # What a block makes of each label before it.
    table = np.full((total, labels, labels), -(1 << 50))
    table[:, np.arange(labels), np.arange(labels)] = 0
    step = max(1, CELLS // (labels * labels))
    for i in range(0, total, step):
        part = table[i : i + step]
        for t in range(width):
            np.maximum(part, part.max(axis=2, keepdims=True) - switch, out=part)
            part += s[i : i + step, t][:, None, :]
    enter = np.zeros((total, labels), np.int64)
    alive = np.flatnonzero(count > 1)
    for j in range(1, int(count.max())):
        alive = alive[count[alive] > j]
        enter[first[alive] + j] = (enter[first[alive] + j - 1][:, :, None] + table[first[alive] + j - 1]).max(axis=1)
    back = np.empty((width, total, labels), np.uint8)
    now, own = enter, np.arange(labels)
    for t in range(width):
        best = now.max(axis=1, keepdims=True) - switch
        stay = now >= best
        back[t] = np.where(stay, own, now.argmax(axis=1)[:, None])
        now = np.where(stay, now, best) + s[:, t]
    before = np.tile(own, (total, 1))
    for t in range(width - 1, -1, -1):
        before = np.take_along_axis(back[t], before, 1).astype(np.int64)
    leave = now.argmax(axis=1)
    alive = np.flatnonzero(count > 1)
    for j in range(int(count.max()) - 1, 0, -1):
        which = alive[count[alive] > j]
        leave[first[which] + j - 1] = before[first[which] + j, leave[first[which] + j]]
    for t in range(width - 1, -1, -1):
        out[row[inside[:, t], t]] = leave[inside[:, t]]
        leave = back[t][np.arange(total), leave].astype(np.int64)
    return out


def label(texts: list[list[str]], lexicon: Lexicon) -> tuple[list[str], list[float], np.ndarray, np.ndarray]:
    """Language and score of each text, given as its words; the label of every word, and where texts begin."""
    names = lexicon.model.languages
    edge = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    if not names or not edge[-1]:
        return [UNKNOWN] * len(texts), [0.0] * len(texts), np.zeros(edge[-1], np.int64), edge
    number = lexicon.numbers(texts)
    scores, letters = lexicon.scores[number], lexicon.letters[number]
    labels = viterbi(scores, edge)
    doc = np.repeat(np.arange(len(texts)), np.diff(edge))
    share = np.bincount(doc * len(names) + labels, letters, len(texts) * len(names)).reshape(-1, len(names))
    sums = np.zeros((len(texts), len(names)), np.int64)
    full = np.flatnonzero(np.diff(edge))
    sums[full] = np.add.reduceat(scores.astype(np.int64), edge[full], axis=0)
    best = share.argmax(axis=1)
    lang, score = [], []
    for d, k in enumerate(best.tolist()):
        n = share[d].sum()
        if not n:
            lang.append(UNKNOWN)
            score.append(0.0)
            continue
        rest = np.delete(sums[d], k).max(initial=-(1 << 60))
        lang.append(names[k])
        score.append(float(share[d, k] / n) / (1 + math.exp(-max(-30.0, min(30.0, float(sums[d, k] - rest) / LEAD)))))
    return lang, score, labels, edge


SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("lang", T.StringType())])


def predict(df: DataFrame, model: Model, text_col: str = "text", spans: bool = False, carry: bool = True) -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``, and with ``spans`` the stretches of one language: first sign, one past the last, language.

    ``carry=False`` leaves the text itself out.
    """
    own = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())] + [T.StructField("spans", T.ArrayType(SPAN))] * spans
    base = without(df, *[f.name for f in own if f.name != text_col.lower()])
    where = base.columns.index(text_col)
    kept = [i for i in range(len(base.columns)) if carry or i != where]
    schema = T.StructType([*(base.schema.fields[i] for i in kept), *own])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("lang", pa.string())]))

    def found(text: str | None, labels: np.ndarray) -> list[dict]:
        out: list[dict] = []
        # Lower case can have more signs than the text; where it has, the places are those of the text all the same.
        lowered = text.lower()
        at = list(range(len(text) + 1)) if len(lowered) == len(text) else [*itertools.chain.from_iterable([i] * len(c.lower()) for i, c in enumerate(text)), len(text)]
        for m, k in zip(_WORD.finditer(lowered), labels.tolist(), strict=True):
            name = model.languages[k]
            if not out or out[-1]["lang"] != name:
                out.append({"start": at[m.start()], "stop": 0, "lang": name})
            out[-1]["stop"] = at[m.end()]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model)
        for batch in batches:
            column = batch.column(where)
            sizes = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)))).astype(np.int64)
            for i, j in slices(sizes):
                texts = column.slice(i, j - i).to_pylist()
                lang, score, labels, edge = label([words_of(t) for t in texts], lexicon)
                rows = batch.slice(i, j - i)
                new = [pa.array(lang, pa.string()), pa.array(score, pa.float64())]
                if spans:
                    new.append(pa.array([found(t, labels[edge[d] : edge[d + 1]]) if lang[d] != UNKNOWN else [] for d, t in enumerate(texts)], kind))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), *new], schema.names)

    return base.mapInArrow(run, schema)
