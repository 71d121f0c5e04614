"""URL filters: rules first, then logistic regression on hashed character n-grams.

All work on the URLs is done by Spark's own functions. The model is fitted on the
driver from a small labelled table (at most ``MOST_LABELLED`` rows), with features that the same
expression gives: weights and constant, by gradient descent with a decay of the weights.

Defined results. A null url, or one without ``://``, has empty host and path; no rule fits
it, and the model judges it by what an empty host and path say. Repeated rows are judged alike, urls are taken whole whatever their length, and an
empty table gives an empty result. Of rules of the
same length the one that comes first in the list wins. Columns of the input with the name of one of
the operator's own are replaced.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, without

SLOTS = 16384
SIZES = (3, 4, 5)
MOST_LABELLED = 10_000
THRESHOLD = 0.5
#: Verdict, host, path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
OWN = ("host", "path", "rule", "verdict", "score")

#: The labelled table: topics of hosts that are blocked, words that such names combine with, and words of hosts that are not blocked.
BLOCKED_TOPICS = """casino poker slots jackpot roulette blackjack betting bets gambling bingo pills pharma viagra cialis
adult porn xxx sex cams escort hookup nude spam ads adserver adclick tracker popups clickbait malware phishing
warez crack keygen torrent payday replica lottery""".split()
MODIFIERS = "best online top my super real mega royal lucky hot vip gold quick direct world club zone land bonus cheap deal free shop win".split()
ALLOWED_WORDS = """news library university school museum archive weather city garden kitchen recipes history science
nature travel mountain river forest music theatre gallery journal review reader writer village council hospital clinic
doctor bakery market books maps train station harbour island football tennis chess physics biology chemistry algebra
teacher student forum wiki docs manual handbook software compiler database kernel network photo camera film cinema
winter windows finance address addons leads pocket essex class trade roads threads""".split()
#: Invented names, of consonants and vowels in turn, are allowed too.
CONSONANTS, VOWELS = "b d f g h k l m n p r s t v w z th sh ch st".split(), "a e i o u ai ea ou".split()
ENDINGS = ["", "n", "r", "s", "nd", "nt"]
KINDS = (("https://", "", "com", "/en/12"), ("http://www.", "", "net", "/de/7.html"), ("https://m.", ".example", "org", "/fr/340?page=2"), ("http://blog.", ".example", "com", "/es/9/"))


def invented(number: int = 400) -> list[str]:
    def pick(of: list[str], k: int) -> str:
        return of[zlib.crc32(str(k).encode()) % len(of)]

    return ["".join(pick(CONSONANTS, 31 * k + j) + pick(VOWELS, 17 * k + j + 1) for j in range(1 + k % 3)) + pick(ENDINGS, k) for k in range(number)]


def labelled() -> list[tuple[str, int]]:
    """The labelled URLs: each name below every kind of host and path, 1 for blocked; and what has no host, which is allowed."""
    blocked = [x for k, t in enumerate(BLOCKED_TOPICS) for m in (MODIFIERS[(5 * k + j) % len(MODIFIERS)] for j in (0, 3, 7, 12)) for x in (f"{t}-{m}", f"{m}{t}")] + BLOCKED_TOPICS
    words = ALLOWED_WORDS
    pairs = [f"{w}{'-' if k % 2 else ''}{words[(7 * k + 3) % len(words)]}" for k, w in enumerate(words)]
    mixed = [f"{m}-{words[(11 * k) % len(words)]}" for k, m in enumerate(MODIFIERS)] + [f"{words[(13 * k + 5) % len(words)]}{m}" for k, m in enumerate(MODIFIERS)]
    out = [("", 0)] * 8
    for label, names in ((1, blocked), (0, [*words, *pairs, *mixed, *invented()])):
        out += [(f"{scheme}{name}{mid}.{tld}{path}", label) for name in names for scheme, mid, tld, path in KINDS]
    return out


def host_of(url: Column) -> Column:
    """What stands after the first :// up to / ? # or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as ``host + path`` and verdict; null where none does."""
    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in reversed(ranked):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def slots(host: Column, path: Column) -> Column:
    """The slots of the n-grams of the host and of the path, with repeats."""

    def grams(text: Column, mark: str) -> list[Column]:
        framed = F.concat(F.lit("^"), text, F.lit("$"))
        out = []
        for n in SIZES:
            last = F.length(framed) - (n - 1)
            at = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
            out.append(F.transform(at, slot(framed, mark, n)))
        return out

    def slot(framed: Column, mark: str, n: int):
        return lambda i: F.pmod(F.xxhash64(F.concat(F.lit(f"{mark}{n}:"), F.substr(framed, i, F.lit(n)))), F.lit(SLOTS)).cast("int")

    # The digits of a path tell nothing.
    plain = F.regexp_replace(path, "[0-9]+", "0")
    return F.concat(*grams(host, "h"), *grams(plain, "p"))


@functools.lru_cache(maxsize=8)
def _fit(rows: tuple[tuple[tuple[int, ...], int], ...], rounds: int = 800, rate: float = 40.0, decay: float = 2e-5) -> tuple[tuple[float, ...], float]:
    """Gradient descent on a bounded table: weights by slot, and the constant."""
    size = np.array([len(at) for at, _ in rows], np.int64)
    flat = np.fromiter((k for at, _ in rows for k in at), np.int64, int(size.sum()))
    row = np.repeat(np.arange(len(rows)), size)
    value = (1 / np.sqrt(np.maximum(size, 1)))[row]
    y = np.array([label for _, label in rows], float)
    w, b = np.zeros(SLOTS), 0.0
    for _ in range(rounds):
        logit = np.bincount(row, w[flat] * value, minlength=len(rows)) + b
        miss = (1 / (1 + np.exp(-logit)) - y) / max(1, len(rows))
        w -= rate * (np.bincount(flat, miss[row] * value, minlength=SLOTS) + decay * w)
        b -= miss.sum()
    return tuple(w.tolist()), float(b)


def model(spark: SparkSession, table: list[tuple[str, int]] | None = None) -> tuple[tuple[float, ...], float]:
    """Weights and constant from a labelled table of (url, 0 or 1)."""
    table = labelled() if table is None else table
    if len(table) > MOST_LABELLED:
        raise ValueError(f"the labelled table has {len(table)} rows; at most {MOST_LABELLED} are taken")
    df = spark.createDataFrame(table, "url string, label int")
    got = df.select(slots(host_of(F.col("url")), path_of(F.col("url"))).alias("s"), "label").collect()
    return _fit(tuple((tuple(r["s"]), r["label"]) for r in got))


def score(host: Column, path: Column, weights: tuple[float, ...], constant: float) -> Column:
    """The probability that the URL is to be blocked."""
    table = F.split(F.lit(" ".join(map(repr, weights))), " ").cast("array<double>")
    at = slots(host, path)
    dot = F.aggregate(at, F.lit(0.0), lambda a, i: a + F.get(table, i))
    norm = F.sqrt(F.greatest(F.size(at), F.lit(1)).cast("double"))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(dot / norm + F.lit(constant))))


def judge(df: DataFrame, url_col: str = "url", rules: list[tuple[str, str, str]] | None = None, table: list[tuple[str, int]] | None = None) -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule``, ``verdict`` and ``score``."""
    rules = RULES if rules is None else rules
    weights, constant = model(df.sparkSession, table)
    base = without(df, *[o for o in OWN if o != url_col.lower()])
    parts = base.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    scored = parts.withColumn("score", score(F.col("host"), F.col("path"), weights, constant))
    return scored.withColumns({"rule": name, "verdict": F.coalesce(verdict, F.when(F.col("score") >= THRESHOLD, "block").otherwise("allow"))})
