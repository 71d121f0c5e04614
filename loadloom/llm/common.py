"""Helpers of the subpackage: shared storage, spare column names, Arrow buffers."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes of [\x20\x09-\x0D], which part words from each other.
BLANKS = " \t\n\v\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Python kernels take texts in slices of about so many bytes; a longer text is a slice of its own.
SLICE_BYTES = 500_000
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8_000_000


def bounded(spark: SparkSession) -> None:
    """Let batches that go to Python hold BATCH_BYTES at most, unless the session says otherwise: 10,000 very long texts are no batch."""
    if not spark.sparkContext.getConf().contains(BATCH_CONF):
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _own_dir(application: str) -> str:
    """A folder of this machine, one for each application."""
    return tempfile.mkdtemp(prefix="loadloom-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` where it is set. Where it isn't: a folder of this
    machine on a local master (tests), the warehouse on any other.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found:
        alone = context.master.startswith("local") and "cluster" not in context.master
        found = _own_dir(context.applicationId) if alone else spark.conf.get("spark.sql.warehouse.dir")
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/loadloom/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table of :func:`materialize`, in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Shelf:
    """Tables in the shared folder that one operator works with and deletes at its end."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it again: a cut of the lineage that outlives executors."""
        bounded(self.spark)
        self.paths.append(shared_path(self.spark, name))
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def clear(self) -> None:
        for path in self.paths:
            delete(self.spark, path)
        self.paths.clear()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder, where it stays, and read it again."""
    return Shelf(df.sparkSession).put(df, name)


def spare(df: DataFrame, *wanted: str) -> list[str]:
    """Names like ``wanted`` that no column of ``df`` has, whatever the letter case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns of these names, in any letter case: an operator's own columns take their place."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string array and the n + 1 offsets into them; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offs, data = texts.buffers()
    at = np.frombuffer(offs, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def slices(at: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes each, or of one row."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


#: Values of a range that one polynomial covers.
CHUNK = 256


class Rolling:
    """Prefix sums of a polynomial over uint64 that give the hash of any range in one step."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self) -> None:
        self.pow = np.ones(1, np.uint64)
        self.inv = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.pow) < n:
            n = max(n, 2 * len(self.pow))
            step = np.full(n, self.BASE, np.uint64)
            step[0] = 1
            back = np.full(n, np.uint64(pow(int(self.BASE), -1, 1 << 64)), np.uint64)
            back[0] = 1
            self.pow, self.inv = np.cumprod(step, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
        return self.pow, self.inv

    def prefix(self, values: np.ndarray) -> np.ndarray:
        p, _ = self.powers(len(values))
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * p[: len(values)], out=out[1:], dtype=np.uint64)
        return out

    def ranges(self, prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The polynomial of each range; for ranges of up to CHUNK values."""
        _, q = self.powers(len(prefix) + 1)
        return (prefix[hi] - prefix[lo]) * q[lo]

    def spans(self, prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The hash of each range of any length. Polynomials modulo a power of two are weak over thousands of values, so a longer range is the sum of its mixed chunks."""
        number = np.maximum(1, -(-(hi - lo) // CHUNK))
        if number.max(initial=1) == 1:
            return mix(self.ranges(prefix, lo, hi) + (hi - lo).astype(np.uint64))
        first = np.concatenate(([0], np.cumsum(number)[:-1]))
        place = np.arange(int(number.sum())) - np.repeat(first, number)
        start = np.repeat(lo, number) + place * CHUNK
        end = np.minimum(start + CHUNK, np.repeat(hi, number))
        # The first chunk counts as it is, so that a range of one chunk has the same hash in either way.
        each = self.ranges(prefix, start, end)
        later = place > 0
        each[later] = mix(each[later] + mix(place[later].astype(np.uint64)))
        return mix(np.add.reduceat(each, first) + (hi - lo).astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 in which each bit of the input moves half of the output's."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


ROLL = Rolling()
BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64))
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[ord(c) for c in BLANKS]] = True


def words_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie one after another from at[0] to at[-1]: each word's start, end, text and hash (starts from at[0])."""
    part = raw[at[0] : at[-1]]
    edge = (at - at[0]).astype(np.int64)
    if not len(part):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    solid = ~IS_BLANK[part]
    first, last = np.empty(len(part), bool), np.empty(len(part), bool)
    first[0], first[1:] = True, ~solid[:-1]
    last[-1], last[:-1] = True, ~solid[1:]
    inner = edge[(edge > 0) & (edge < len(part))]
    first[inner] = True
    last[inner - 1] = True
    lo = np.flatnonzero(solid & first)
    hi = np.flatnonzero(solid & last) + 1
    sums = ROLL.prefix(BYTE_CODE[part])
    codes = ROLL.spans(sums, lo, hi)
    return lo, hi, np.searchsorted(edge, lo, side="right") - 1, codes
