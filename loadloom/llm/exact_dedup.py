"""Exact duplicates, with frequent digests split off.

A table of a third equal rows sends a third of a shuffle to one task. So Misra-Gries
summaries, one a partition, find every digest with more than a set share of the rows;
the exact winner of each is looked up again over all rows ("verified") with partial
sums, the few winners are broadcast, and their copies are settled on the map side.
All other digests go through an ordinary shuffle, in groups of a bounded share.

Defined results. A null text counts as empty. A null id comes after every other id.
Equal ids with equal texts are one document repeated: exactly one of these rows stays.
An empty table gives an empty result. Columns of the input that have the name of one of
the operator's own are replaced; all others are kept.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BLANKS, materialize, spare, without

#: Counters of a summary, and so the most digests that can be broadcast.
COUNTERS = 4096
#: Digests of fewer copies than this need no split.
LEAST_COPIES = 64
OWN = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text: Column) -> Column:
    """The text without blanks; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(normalised(text), "UTF-8"), 256))


def summarise(counts: dict, most: int) -> None:
    """Take the (most + 1)-th largest count from all and drop what is left without any (in place)."""
    if len(counts) > most:
        cut = heapq.nlargest(most + 1, counts.values())[-1]
        for k in [k for k, v in counts.items() if v <= cut]:
            del counts[k]
        for k in counts:
            counts[k] -= cut


def frequent(digests: DataFrame, column: str, most: int = COUNTERS) -> DataFrame:
    """Misra-Gries over one binary column: ``key`` and a lower bound ``n`` of its count.

    Each partition's summary misses at most 1 / (most + 1) of its rows for any key, so the
    sums miss at most that share of all rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for batch in batches:
            seen = pc.value_counts(batch.column(0))
            for k, n in zip(seen.field("values").to_pylist(), seen.field("counts").to_pylist(), strict=True):
                counts[k] = counts.get(k, 0) + n
            summarise(counts, most)
        # A key seen once says nothing here that the sums need: the bound below is far above.
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["key", "n"])

    parts = digests.select(F.col(column).alias("key")).mapInArrow(run, "key binary, n long")
    return parts.groupBy("key").agg(F.sum("n").alias("n"))


def mark(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS, least: int = LEAST_COPIES, carry: bool = True) -> DataFrame:
    """Every row of ``df`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Of equal texts the row with the most code points stays, then the smallest id.
    ``carry=False`` leaves only the id of the input's columns. Texts are read once; rows are written with their digest and a number of their
    own, by which one of a repeated row stays wherever they lie.
    """
    base = without(df, *OWN) if carry else df.select(id_col, text_col)
    dig, size, win, n, row = spare(base, "_digest", "_size", "_win", "_n", "_row")
    keyed = base.withColumns({dig: digest(F.col(text_col)), size: F.coalesce(F.length(text_col), F.lit(0)).cast("long"), row: F.monotonically_increasing_id()})
    rows = materialize(keyed if carry else keyed.select(id_col, dig, size, row), "digests")
    total = rows.count()
    bound = max(least, -(-total // counters))
    # Counts sum to at most the number of rows, so at most `counters` keys reach the bound.
    found = [r["key"] for r in frequent(rows.select(dig), dig, 2 * counters).where(F.col("n") * 2 >= bound).select("key").collect()]
    order = F.struct((-F.col(size)).alias("a"), F.col(id_col).isNull().alias("b"), F.col(id_col).alias("c"), F.col(row).alias("d"))
    by = Window.partitionBy(dig).orderBy(F.col(size).desc(), F.col(id_col).asc_nulls_last())
    full = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def out(part: DataFrame, keep: Column, count: Column, kept: Column) -> DataFrame:
        kept_columns = [F.col(f"`{c}`") for c in (base.columns if carry else [id_col])]
        return part.select(*kept_columns, keep.alias("keep_id"), count.cast("long").alias("group_size"), kept.alias("kept"), F.lower(F.hex(dig)).alias("text_sha256"))

    def by_shuffle(part: DataFrame) -> DataFrame:
        return out(part, F.first(id_col).over(full), F.count(F.lit(1)).over(full), F.row_number().over(by) == 1)

    if not found:
        return by_shuffle(rows)
    spark = df.sparkSession
    candidates = F.broadcast(spark.createDataFrame([(bytes(k),) for k in found], f"`{dig}` binary"))
    heavy = rows.join(candidates, dig).groupBy(dig).agg(F.count(F.lit(1)).alias(n), F.min(order).alias(win))
    heavy = materialize(heavy.where(F.col(n) >= least), "winners")  # at most 4 * counters rows
    joined = rows.join(F.broadcast(heavy), dig, "left")
    light = by_shuffle(joined.where(F.col(n).isNull()).drop(n, win))
    return light.unionByName(out(joined.where(F.col(n).isNotNull()), F.col(f"{win}.c"), F.col(n), F.col(row) == F.col(f"{win}.d")))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows that stay, with the columns of ``df``."""
    clash = {o for o in OWN if o in {c.lower() for c in df.columns}}
    renamed = df.withColumnsRenamed({c: f"__own_{c}" for c in df.columns if c.lower() in clash})
    kept = mark(renamed, id_col, text_col, counters).where("kept")
    return kept.drop(*OWN).withColumnsRenamed({f"__own_{c}": c for c in df.columns if c.lower() in clash}).select(*[F.col(f"`{c}`") for c in df.columns])


#: DuckDB SQL of op4's result.
SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS size,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id) = 1 AS kept,
       text_sha256
FROM d
"""
