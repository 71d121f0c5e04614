"""Exact numbers of the rows and quantiles of the groups of a table of any size, and tables that are computed once."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Low bits of monotonically_increasing_id: the row within its partition.
ROW_BITS = (1 << 33) - 1


def held(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the session's checkpoint folder: a cut of the lineage that outlives executors.

    The folder is ``spark.checkpoint.dir``; where that isn't set, one of this machine on a local master, and an error on any other, whose executors
    would not see it. Spark deletes the files with the DataFrame under ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and (not context.master.startswith("local") or "cluster" in context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="loadloom-"))
    return df.checkpoint()


def numbered(df: DataFrame, order: list, out: str, by: str | None = None, ready: bool = False) -> DataFrame:
    """Numbers from 1 in the order of the columns ``order``, within each value of ``by``; no task holds more than its range.

    The rows, computed once, are sorted over ranges of all of ``order``, so that runs of equal values are dealt by what breaks the tie; each row knows its place in
    its partition of one written table, and the sizes of the partitions before (one row a partition) move it up. ``ready``: df is such a table already.
    """
    keys = ([F.col(by)] if by else []) + [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = (df if ready else held(df)).repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = held(ranged.withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id().bitwiseAND(ROW_BITS)}))
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    got = rows.join(F.broadcast(before), "__part").withColumn(out, F.col("__before") + F.col("__row") + 1).drop("__part", "__row", "__before")
    if by:
        first = got.groupBy(F.col(by).alias("__by")).agg(F.min(out).alias("__first"))
        got = got.join(first, F.col(by).eqNullSafe(F.col("__by"))).withColumn(out, F.col(out) - F.col("__first") + 1).drop("__by", "__first")
    return got


#: Rows whose distinct values one task may hold.
SMALL = 1_000_000


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``__n`` of the rows of a sorted partition -> the sum of those before."""
    before = 0
    for batch in batches:
        sums = np.cumsum(batch.column("__n").to_numpy()) + before
        first = np.concatenate(([before], sums[:-1])) if len(sums) else sums
        before = int(sums[-1]) if len(sums) else before
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first.astype(np.int64))], [*batch.schema.names, "__before"])


def _same(a: DataFrame, b: DataFrame, groups: list[str]) -> DataFrame:
    """``a`` with the columns of ``b``, whose groups are named ``__0``, ``__1``, ..."""
    on = F.lit(True)
    for i, g in enumerate(groups):
        on = on & a[g].eqNullSafe(b[f"__{i}"])
    return a.join(b, on, "left").drop(*[f"__{i}" for i in range(len(groups))])


def quantiles_by_rank(rows: DataFrame, groups: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``__0, __1, ...`` (the groups) and the exact quantiles of each, with linear interpolation, for groups of any size.

    Values are counted before they are shuffled, so that one that most rows have is a single row; the distinct ones are sorted over ranges of (group, value),
    with running counts within a range and sums of the ranges before. The two values at each rank asked for are then picked by their counts: a
    task holds a range of the distinct values, however they are spread over the groups.
    """
    named = [F.col(g).alias(f"__{i}") for i, g in enumerate(groups)]
    counts = rows.where(F.col(value).isNotNull()).groupBy(*named, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    keys = [f"__{i}" for i in range(len(groups))]
    ranged = held(counts).repartitionByRange(*keys, "__v").sortWithinPartitions(*keys, "__v")
    ranged = ranged.withColumn("__part", F.spark_partition_id())
    schema = T.StructType([*ranged.schema.fields, T.StructField("__before", T.LongType())])
    run = held(ranged.mapInArrow(_running, schema))
    parts = run.groupBy("__part").agg(F.sum("__n").alias("__size"))
    parts = parts.select("__part", (F.sum("__size").over(Window.orderBy("__part")) - F.col("__size")).alias("__moved"))
    run = run.join(F.broadcast(parts), "__part").withColumn("__before", F.col("__before") + F.col("__moved")).drop("__part", "__moved")
    sizes = run.groupBy(*keys).agg(F.min("__before").alias("__first"), F.sum("__n").alias("__all"))
    at = F.col("share") * (F.col("__all") - 1)
    asked = sizes.select("*", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(s)).alias("share")) for n, s in shares.items()])).alias("x")).select(*keys, "__first", "x.*", at.alias("at"))
    # Each group asks for two ranks a quantile; a value answers if its rows lie around the rank.
    tied = [F.col(k).alias(f"a{k}") for k in keys]
    asked = asked.select(*tied, "__first", "name", "at", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank")).distinct()
    on = (F.col("__before") <= F.col("__first") + F.col("rank")) & (F.col("__first") + F.col("rank") < F.col("__before") + F.col("__n"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"a{k}"))
    hits = run.join(asked, on).select(*keys, "name", "at", "rank", F.col("__v").alias("v"))
    low, high = F.min_by("v", "rank"), F.max_by("v", "rank")
    part = F.max("at") - F.min("rank")
    got = hits.groupBy(*keys, "name").agg(F.when(F.count(F.lit(1)) == 1, low).otherwise((F.max("rank") - F.max("at")) * low + part * high).alias("q"))
    return got.groupBy(*keys).pivot("name", list(shares)).agg(F.max("q"))


def with_quantiles(df: DataFrame, groups: list[str], value: str, shares: dict[str, float], aggregates: list) -> DataFrame:
    """``df`` grouped: the aggregates, and the exact quantiles of ``value``. Tables of over SMALL rows are ranked, smaller ones have no group that a task couldn't hold."""
    rows = held(df.select(*groups, value))
    if rows.limit(SMALL + 1).count() <= SMALL:
        p = F.percentile(F.col(value).cast("double"), list(shares.values()))
        got = rows.groupBy(*groups).agg(*aggregates, p.alias("__p"))
        return got.withColumns({n: F.col("__p")[i] for i, n in enumerate(shares)}).drop("__p")
    return _same(rows.groupBy(*groups).agg(*aggregates), quantiles_by_rank(rows, groups, value, shares), groups)
