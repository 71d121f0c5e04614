"""Load profiles, in long form: one row for each slot or hour of a key and period."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.calendar import band, day_type, weekday


def slots(df: DataFrame, key: str, date: str, q: str) -> DataFrame:
    """Rows of slots (from 1) of rows with a vector of slots."""
    return df.select(key, date, F.posexplode(q).alias("slot", "v")).withColumn("slot", F.col("slot") + 1)


def slot_means(df: DataFrame, key: str, date: str, q: str, empty: bool = True) -> DataFrame:
    """Means of the slots by key and month; nulls are skipped, years pooled.

    Slots that have no value at all are rows of null. Without ``empty`` they are left out, and only slots with a value are shuffled: a vector with few is few rows. One without any is then a row
    without a slot, so that its key and month are seen.
    """
    rows = df.where(F.col(key).isNotNull())
    if empty:
        long = slots(rows, key, date, q)
    else:
        cells = rows.select(key, date, F.array_max(q).isNull().alias("__none"), F.posexplode(q).alias("__at", "v"))
        cells = cells.where(F.col("v").isNotNull() | (F.col("__none") & (F.col("__at") == 0)))
        long = cells.select(key, date, F.when(F.col("v").isNotNull(), F.col("__at") + 1).alias("slot"), "v")
    return long.groupBy(key, F.month(date).alias("month"), "slot").agg(F.avg("v").alias("v"))


def hourly(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Mean of each key, month and hour of readings with a time of day."""
    return df.where(F.col(key).isNotNull()).groupBy(key, F.month(ts).alias("month"), F.hour(ts).alias("hour")).agg(F.avg(value).alias("v"))


def overall(profile: DataFrame, key: str, slot: str = "hour") -> DataFrame:
    """Mean over the months of a profile, each month with equal weight."""
    return profile.groupBy(key, slot).agg(F.avg("v").alias("v"))


def complete_grid(profile: DataFrame, key: str, slot: str, count: int) -> DataFrame:
    """The profile with a row for each key, observed month and slot."""
    months = F.broadcast(profile.select("month").distinct())  # at most 12
    grid = profile.select(key).distinct().join(months).select(key, "month", F.explode(F.sequence(F.lit(1), F.lit(count))).alias(slot))
    return grid.join(profile, [key, "month", slot], "left")


def interpolate(grid: DataFrame, key: str, slot: str, limit: int = 4, by_slot: bool = True) -> DataFrame:
    """Linear interpolation with a limit, both ways.

    Cells of a key stand in one line: slot by slot, and within a slot month by month (``by_slot``), or the other way. A null
    cell is filled if one with a value is at most ``limit`` places away: on the line between its neighbours, or by the only one there is.
    """
    order = [slot, "month"] if by_slot else ["month", slot]
    line = Window.partitionBy(key).orderBy(*order)
    at = grid.withColumn("__i", F.row_number().over(line))
    before, after = line.rowsBetween(Window.unboundedPreceding, 0), line.rowsBetween(0, Window.unboundedFollowing)
    there = F.when(F.col("v").isNotNull(), F.col("__i"))
    at = at.withColumns({"__p": F.last(there, True).over(before), "__pv": F.last("v", True).over(before), "__n": F.first(there, True).over(after), "__nv": F.first("v", True).over(after)})
    near = (F.col("__i") - F.col("__p") <= limit) | (F.col("__n") - F.col("__i") <= limit)
    on_line = F.col("__pv") + (F.col("__nv") - F.col("__pv")) * F.try_divide(F.col("__i") - F.col("__p"), F.col("__n") - F.col("__p"))
    filled = F.when(F.col("v").isNotNull(), F.col("v")).when(F.coalesce(near, F.lit(False)), F.coalesce(on_line, "__pv", "__nv"))
    return at.withColumn("v", filled).drop("__i", "__p", "__pv", "__n", "__nv")


def fill_within_month(grid: DataFrame, key: str, slot: str) -> DataFrame:
    """Forward, then backward along the slots of each month."""
    w = Window.partitionBy(key, "month").orderBy(slot)
    forward = F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    step = grid.withColumn("v", F.coalesce("v", forward))
    return step.withColumn("v", F.coalesce("v", F.first("v", True).over(w.rowsBetween(0, Window.unboundedFollowing))))


def fill_with_median(grid: DataFrame, key: str) -> DataFrame:
    """What is still null gets the key's median, then 0."""
    median = F.median("v").over(Window.partitionBy(key))
    return grid.withColumn("v", F.coalesce(F.col("v"), median, F.lit(0.0)))


def drop_all_zero(grid: DataFrame, key: str) -> DataFrame:
    return grid.withColumn("__any", F.max(F.abs("v")).over(Window.partitionBy(key))).where("__any > 0").drop("__any")


def minmax(profile: DataFrame, keys: list[str], value: str = "v", out: str = "norm") -> DataFrame:
    """From 0 to 1 within the keys; 0 where all are equal."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return profile.withColumn(out, F.when(F.col(value).isNotNull(), F.coalesce(F.try_divide(F.col(value) - lo, hi - lo), F.lit(0.0))))


def observed_months(df: DataFrame, month: Column) -> list[int]:
    """The months that occur, at most twelve: one narrow pass over a date."""
    return sorted(r[0] for r in df.select(month.alias("m")).where("m is not null").distinct().collect())


#: How far :func:`packed` goes: interpolation, filling within the month, the key's median and no key without energy, scaled values.
STEPS = ("interpolated", "filled", "whole", "scaled")


def _last_before(there: np.ndarray) -> np.ndarray:
    """Along the last axis the place of the last cell with a value up to each; -1 where there is none."""
    return np.maximum.accumulate(np.where(there, np.arange(there.shape[-1]), -1), axis=-1)


def _interpolated(line: np.ndarray, limit: int) -> np.ndarray:
    """Rows of cells, nan where there is none, by the rule of :func:`interpolate`."""
    there, at = ~np.isnan(line), np.arange(line.shape[1])
    before = _last_before(there)
    after = line.shape[1] - 1 - _last_before(there[:, ::-1])[:, ::-1]
    left, right = before >= 0, after < line.shape[1]
    own = np.arange(len(line))[:, None]
    low, high = line[own, np.maximum(before, 0)], line[own, np.minimum(after, line.shape[1] - 1)]
    near = left & (at - before <= limit) | right & (after - at <= limit)
    on_line = low + (high - low) * ((at - before) / np.maximum(1, after - before))
    return np.where(there, line, np.where(near, np.where(left & right, on_line, np.where(left, low, high)), np.nan))


def _carried(cells: np.ndarray) -> np.ndarray:
    """Each cell without a value takes that of the last one before it on the last axis."""
    at = _last_before(~np.isnan(cells))
    return np.where(at >= 0, np.take_along_axis(cells, np.maximum(at, 0), -1), np.nan)


def _filled(cells: np.ndarray, step: str, limit: int, by_slot: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys x months x slots -> which keys stay, their values and the values scaled within each month."""
    n, months, count = cells.shape
    line = cells.transpose(0, 2, 1) if by_slot else cells
    line = _interpolated(line.reshape(n, months * count), limit)
    v = line.reshape(n, count, months).transpose(0, 2, 1) if by_slot else line.reshape(n, months, count)
    stay = np.ones(n, bool)
    if step != STEPS[0]:
        v = _carried(v)
        v = _carried(v[:, :, ::-1])[:, :, ::-1]
    if step in STEPS[2:]:
        flat = v.reshape(n, -1)
        known = ~np.isnan(flat).all(axis=1)
        median = np.zeros(n)
        median[known] = np.nanmedian(flat[known], axis=1)
        v = np.where(np.isnan(v), median[:, None, None], v)
        stay = np.abs(v).max(axis=(1, 2), initial=0) > 0
    lo, hi = v.min(axis=2, keepdims=True), v.max(axis=2, keepdims=True)
    return stay, v, np.where(hi > lo, (v - lo) / np.where(hi > lo, hi - lo, 1), 0.0)


#: Keys whose cells are filled at once.
KEYS = 1024


def _by_key(means: DataFrame, key: str, months: list[int], slot: str, count: int, names: list[str], kernel) -> DataFrame:
    """``key`` and arrays of the ``names``: of each key one dense array of its cells, month by month and slot by slot (from 1), through ``kernel``: keys x months x slots, nan where there is no value -> which
    keys stay, and as many arrays of the same shape as names."""
    cells = means.where(F.col(key).isNotNull() & F.col(slot).isNotNull()).groupBy(key).agg(F.collect_list(F.struct("month", F.col(slot).alias("slot"), F.col("v").cast("double").alias("v"))).alias("cells"))
    place = {m: i for i, m in enumerate(months)}
    lookup = np.full(13, -1)
    lookup[list(place)] = list(place.values())
    schema = T.StructType([cells.schema[key], *(T.StructField(n, T.ArrayType(T.DoubleType())) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, KEYS) for b in batches for at in range(0, b.num_rows, KEYS)):
            lists = batch.column("cells")
            flat = lists.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            at, where, v = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("month", "slot", "v"))
            dense = np.full((batch.num_rows, len(months), count), np.nan)
            ok = (lookup[at] >= 0) & (where >= 1) & (where <= count)
            dense[row[ok], lookup[at[ok]], where[ok] - 1] = v[ok]
            stay, *full = kernel(dense)
            offsets = pa.array((np.arange(int(stay.sum()) + 1) * len(months) * count).astype(np.int32))
            arrays = [pa.ListArray.from_arrays(offsets, pa.array(a[stay].ravel(), pa.float64(), from_pandas=True)) for a in full[: len(names)]]
            yield pa.RecordBatch.from_arrays([batch.column(key).filter(pa.array(stay)), *arrays], schema.names)

    return cells.mapInArrow(run, schema)


def packed(means: DataFrame, key: str, months: list[int], slot: str = "slot", count: int = 96, step: str = STEPS[-1], limit: int = 4, by_slot: bool = True) -> DataFrame:
    """``key, v`` and, scaled, ``norm``: of each key one dense array of its cells, month by month and slot by slot (from 1), filled as far as ``step`` says.

    The cells of a key are gathered once (at most 12 x count of them) and all rules are applied to whole batches of keys in one kernel: no grid is joined, and no window sorts it.
    Cells of other months are left out; a cell without a value is null up to the step ``filled``.
    """
    return _by_key(means, key, months, slot, count, ["v", "norm"] if step == STEPS[-1] else ["v"], lambda dense: _filled(dense, step, limit, by_slot))


def _strict(cells: np.ndarray, least_months: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like :func:`_filled` by the older rule: keys with at least ``least_months`` times the slots of values, interpolated without limit slot by slot; a key with a constant month doesn't stay."""
    n, months, count = cells.shape
    line = cells.transpose(0, 2, 1).reshape(n, months * count)
    v = _interpolated(line, months * count).reshape(n, count, months).transpose(0, 2, 1)
    lo, hi = v.min(axis=2, keepdims=True), v.max(axis=2, keepdims=True)
    stay = ((~np.isnan(line)).sum(axis=1) >= least_months * count) & (hi - lo > 0).all(axis=(1, 2))
    return stay, v, (v - lo) / np.where(hi > lo, hi - lo, 1)


def packed_strict(means: DataFrame, key: str, months: list[int], slot: str = "slot", count: int = 96, least_months: float = 6) -> DataFrame:
    """``key, v, norm`` like :func:`packed`, by the older rule: see :func:`_strict`."""
    return _by_key(means, key, months, slot, count, ["v", "norm"], lambda dense: _strict(dense, least_months))


def unpacked(dense: DataFrame, key: str, months: list[int], slot: str = "slot", count: int = 96) -> DataFrame:
    """The arrays of :func:`packed` as rows: ``key, month, slot, v`` (and ``norm``)."""
    own = [c for c in ("v", "norm") if c in dense.columns]
    rows = dense.select(key, F.posexplode(F.arrays_zip(*own)).alias("__at", "__x"))
    month = F.element_at(F.array(*[F.lit(m) for m in months]).cast("array<int>"), (F.col("__at") / count).cast("int") + 1)
    return rows.select(key, month.alias("month"), (F.col("__at") % count + 1).cast("int").alias(slot), *[F.col(f"__x.{c}").alias(c) for c in own])


def daily_profiles(df: DataFrame, key: str, date: str, q: str, count: int = 96, limit: int = 4) -> DataFrame:
    """Filled and scaled profiles by key, month and slot: ``v`` and ``norm``. Months are those of the table."""
    months = observed_months(df, F.month(date))
    dense = packed(slot_means(df, key, date, q), key, months, count=count, limit=limit)
    return unpacked(dense, key, months, count=count)


def packed_months(df: DataFrame, key: str, date: str, q: str, count: int = 96, limit: int = 4) -> DataFrame:
    """``key, month, features``: the scaled profile of each month as a vector, for clustering month by month."""
    months = observed_months(df, F.month(date))
    dense = packed(slot_means(df, key, date, q), key, months, count=count, limit=limit)
    each = F.array(*[F.struct(F.lit(m).alias("month"), F.slice("norm", i * count + 1, count).alias("features")) for i, m in enumerate(months)]) if months else None
    if each is None:
        return dense.select(key, F.lit(0).alias("month"), F.col("norm").alias("features")).limit(0)
    return dense.select(key, F.explode(each).alias("x")).select(key, "x.month", "x.features")


def _daily(df: DataFrame, key: str, ts: str, value: str, by_year: bool) -> tuple[DataFrame, list[str]]:
    """Sums by key, day and hour, and the columns of a month: with the year, or pooled over the years."""
    daily = df.where(F.col(key).isNotNull()).groupBy(key, F.to_date(ts).alias("day"), F.hour(ts).alias("hour")).agg(F.sum(F.coalesce(F.col(value), F.lit(0.0))).alias("v"))
    months = {"year": F.year("day"), "month": F.month("day")} if by_year else {"month": F.month("day")}
    return daily.withColumns(months), list(months)


def monthly_share(df: DataFrame, key: str, ts: str, value: str, by_year: bool = False) -> DataFrame:
    """Each hour's mean as a percentage of its key's energy in the month, then the plain mean over keys; ``by_year`` keeps the years apart."""
    daily, months = _daily(df, key, ts, value, by_year)
    by_key = daily.groupBy(key, *months, "hour").agg(F.sum("v").alias("s"))
    days = daily.groupBy(key, *months).agg(F.countDistinct("day").alias("days"), F.sum("v").alias("all")).where("all > 0")
    got = by_key.join(days, [key, *months]).withColumn("pct", F.col("s") / F.col("days") / F.col("all") * 100)
    return got.groupBy(*months, "hour").agg(F.avg("pct").alias("pct"))


def band_share(df: DataFrame, key: str, ts: str, value: str, by_year: bool = False) -> DataFrame:
    """Each hour of a day as a percentage of its band's energy in the month; mean over days, then over keys; ``by_year`` keeps the years apart."""
    daily, months = _daily(df, key, ts, value, by_year)
    daily = daily.withColumn("band", band(weekday(F.col("day")), F.col("hour")))
    total = F.sum("v").over(Window.partitionBy(key, *months, "band"))
    share = daily.withColumn("t", total).withColumn("pct", F.when(F.col("t") > 0, 100 * F.col("v") / F.col("t")))
    return share.groupBy(key, *months, "hour").agg(F.avg("pct").alias("pct")).groupBy(*months, "hour").agg(F.avg("pct").alias("pct"))


def by_day_type(df: DataFrame, key: str, ts: str, value: str, scale: float = 1.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean by key, day type, month and hour, then over keys (within ``by``); month 0 is the mean of the months there are."""
    first = df.where(F.col(key).isNotNull()).groupBy(*by, key, day_type(F.col(ts)).alias("daytype"), F.month(ts).alias("month"), F.hour(ts).alias("hour")).agg((F.avg(value) * scale).alias("v"))
    months = first.groupBy(*by, "daytype", "month", "hour").agg(F.avg("v").alias("v"))
    return months.unionByName(months.groupBy(*by, "daytype", "hour").agg(F.avg("v").alias("v")).withColumn("month", F.lit(0)).select(*by, "daytype", "month", "hour", "v"))


def reference_means(df: DataFrame, column: str, month: str = "month", hour: str = "hour") -> DataFrame:
    """A reference's mean by month and hour, with a row for each of the 24 hours."""
    got = df.groupBy(month, hour).agg(F.avg(column).alias("v"))
    grid = df.select(month).distinct().select(month, F.explode(F.sequence(F.lit(0), F.lit(23))).alias(hour))
    return grid.join(got, [month, hour], "left")


def reference_vector(df: DataFrame, keys: list[str], hour: str, value: str, count: int = 24) -> DataFrame:
    """Values by hour as an array; only groups with all hours."""
    got = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(hour, value))).alias("p"))
    return got.where(F.size("p") == count).select(*keys, F.transform("p", lambda s: s[value]).alias("vector"))


def sigma_band(df: DataFrame, keys: list[str], value: str, clip: bool = True) -> DataFrame:
    """Mean and one deviation either side, clipped to 0..1."""
    got = df.groupBy(*keys).agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    low, high = F.col("m") - F.col("s"), F.col("m") + F.col("s")
    if clip:
        low, high = F.greatest(F.lit(0.0), low), F.least(F.lit(1.0), high)
    return got.select(*keys, F.col("m").alias("mean"), low.alias("low"), high.alias("high"))


def year_vector(df: DataFrame, keys: list[str], month: str, hour: str, value: str) -> DataFrame:
    """Twelve months of 24 hours in a row as one array of 288; only groups with all of them."""
    got = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(month, hour, value))).alias("p"))
    return got.where(F.size("p") == 288).select(*keys, F.transform("p", lambda s: s[value]).alias("vector"))
