"""The exploration funnel: census, coverage, completeness, consumption, power.

Operators take the roles of columns: ``key`` (the metered point), ``ts``, ``value``, and the columns of a group.
Null keys are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import binning
from ..functions.calendar import month_index, period
from .ranking import with_quantiles


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by the order columns, which include a tie-break."""
    w = Window.partitionBy(key).orderBy(*[F.col(o).desc_nulls_last() for o in order])
    return df.where(F.col(key).isNotNull()).withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def last_valid(df: DataFrame, key: str, value: str, order: list[str], out: str | None = None) -> DataFrame:
    """The last value of each key that isn't null: partial maxima, no sort."""
    picked = F.max_by(F.col(value), F.struct(*order)).alias(out or value)
    return df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key).agg(picked)


def census(df: DataFrame, groups: list[str], key: str) -> DataFrame:
    """Distinct keys by group, their share and the running total of the rounded shares."""
    n = df.where(F.col(key).isNotNull()).groupBy(*groups).agg(F.countDistinct(key).alias("n_keys"))
    total = n.agg(F.sum("n_keys").alias("__total"))
    shared = n.join(F.broadcast(total)).withColumn("pct", F.round(100.0 * F.col("n_keys") / F.col("__total"), 2)).drop("__total")
    # The groups of a census are few; their running total needs them in one order.
    w = Window.orderBy(F.col("n_keys").desc(), *groups).rowsBetween(Window.unboundedPreceding, 0)
    return shared.withColumn("cum_pct", F.round(F.sum("pct").over(w), 2))


def months_per_key(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Distinct months of each key."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(period(F.col(ts))).alias("n_months"))


def covered(df: DataFrame, key: str, ts: str, least: int = 12) -> DataFrame:
    """The keys with at least so many distinct months."""
    return months_per_key(df, key, ts).where(F.col("n_months") >= least).select(key)


def coverage(df: DataFrame, key: str, ts: str, least: int = 12) -> DataFrame:
    """One row: keys, covered keys, the others, and shares."""
    n = months_per_key(df, key, ts).agg(F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("n_months") >= least).alias("n_covered"))
    n = n.withColumn("n_short", F.col("n_keys") - F.col("n_covered"))
    return n.withColumns({"pct_covered": F.round(F.try_divide(100.0 * F.col("n_covered"), F.col("n_keys")), 2), "pct_short": F.round(F.try_divide(100.0 * F.col("n_short"), F.col("n_keys")), 2)})


def binned(df: DataFrame, number: Column, labels: list[str] | None, base: int | None = None) -> DataFrame:
    """Rows by bin with shares of all rows; rows outside of all bins count in the total alone."""
    counted = df.select(number.alias("bin_no")).groupBy("bin_no").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2)).where("bin_no is not null")
    return counted.withColumn("bin", binning.label(F.col("bin_no"), labels)) if labels else counted


def completeness(df: DataFrame, key: str, ts: str, cells: Column, nulls: Column) -> DataFrame:
    """By key: rows, months, null cells, all cells and the share that is there."""
    got = df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(period(F.col(ts))).alias("n_months"), F.sum(nulls).alias("null_cells"), F.sum(cells).alias("cells")
    )
    return got.withColumn("completeness", F.round(F.try_divide(100.0 * (F.col("cells") - F.col("null_cells")), F.col("cells")), 4))


def monthly(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Sums by key and month."""
    return df.where(F.col(key).isNotNull()).groupBy(key, period(F.col(ts)).alias("period")).agg(F.sum(F.coalesce(F.col(value), F.lit(0.0))).alias("total"))


def summary(df: DataFrame, groups: list[str], value: str, digits: int = 4) -> DataFrame:
    """Count, mean, exact median, deviation (one degree less), least and greatest."""
    r = lambda c, name: F.round(c, digits).alias(name)
    plain = [F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")]
    got = with_quantiles(df, groups, value, {"median": 0.5}, plain)
    return got.select(*groups, "n", *[r(c, c) for c in ("mean", "median", "std", "min", "max")])


def quantiles(df: DataFrame, groups: list[str], value: str, digits: int = 4) -> DataFrame:
    """Median, mean, quartiles (linear interpolation) and greatest."""
    shares = {"p25": 0.25, "median": 0.5, "p75": 0.75}
    got = with_quantiles(df, groups, value, shares, [F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max")])
    return got.select(*groups, "n", *[F.round(c, digits).alias(c) for c in ("p25", "median", "p75", "mean", "max")])


def complete_years(df: DataFrame, key: str, ts: str, value: str, months: int = 12) -> DataFrame:
    """Sums of the (key, year) pairs that have all months, in one pass over the rows."""
    by_month = df.where(F.col(key).isNotNull()).groupBy(key, F.year(ts).alias("year"), F.month(ts).alias("month")).agg(F.sum(F.coalesce(F.col(value), F.lit(0.0))).alias("t"))
    return by_month.groupBy(key, "year").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("total")).where(F.col("n") >= months).drop("n")


def mode_per_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key, the smallest among ties."""
    return df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key).agg(F.mode(value, True).alias("mode"))


def dominant(df: DataFrame, by: list[str], category: str) -> DataFrame:
    """The most frequent category of each group with count and share; ties to the smaller one."""
    n = df.groupBy(*by, category).agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(category).alias("c"))).alias("b"), F.sum("n").alias("total"))
    return best.select(*by, F.col("b.c").alias(category), (-F.col("b.m")).alias("n"), F.round(100.0 * -F.col("b.m") / F.col("total"), 2).alias("pct"))


def top_with_other(df: DataFrame, value: str, count: int = 10, other: str = "Altro") -> DataFrame:
    """The most frequent values and one row for all others."""
    n = df.groupBy(F.col(value).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    top = n.orderBy(F.col("n").desc(), "label").limit(count)
    rest = n.join(F.broadcast(top.select("label")), "label", "left_anti").agg(F.sum("n").alias("n")).where("n is not null")
    return top.unionByName(rest.select(F.lit(other).alias("label"), "n"))


def share(df: DataFrame, groups: list[str], within: list[str]) -> DataFrame:
    """Rows by groups and their share of the rows of ``within``."""
    n = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(*within)), 2))


def runs(df: DataFrame, key: str, ts: str) -> DataFrame:
    """The longest run of neighbouring months of each key, and whether it reaches 12."""
    months = df.where(F.col(key).isNotNull()).select(key, month_index(F.col(ts)).alias("m")).distinct()
    w = Window.partitionBy(key).orderBy("m")
    islands = months.withColumn("island", F.col("m") - F.row_number().over(w)).groupBy(key, "island").agg(F.count(F.lit(1)).alias("n"))
    return islands.groupBy(key).agg(F.max("n").alias("longest")).withColumn("has_12", F.col("longest") >= 12)


def gaps(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Days with data of each key, days from first to last, and the share that is missing."""
    d = F.to_date(ts)
    got = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(d).alias("n_days"), F.min(d).alias("first"), F.max(d).alias("last"))
    got = got.withColumn("expected", (F.datediff("last", "first") + 1).cast("long"))
    got = got.withColumn("missing", F.greatest(F.lit(0).cast("long"), F.col("expected") - F.col("n_days")))
    return got.withColumn("missing_pct", F.round(100.0 * F.col("missing") / F.col("expected"), 2))


def pivot_mean(df: DataFrame, row: str, column: str, columns: list, value: str, digits: int = 2) -> DataFrame:
    """Means by row and column with the mean of the rounded cells of each row."""
    wide = df.groupBy(row).pivot(column, columns).agg(F.round(F.avg(value), digits))
    cells = F.array_compact(F.array(*[F.col(f"`{c}`") for c in columns]))
    mean = F.try_divide(F.aggregate(cells, F.lit(0.0), lambda a, x: a + x), F.size(cells))
    return wide.withColumn("mean_of_cells", F.round(mean, digits))


def pivot_count(df: DataFrame, row: str, column: str, columns: list, key: str, total: str = "total") -> DataFrame:
    """Distinct keys by row and column, 0 where there are none, with a total."""
    wide = df.groupBy(row).pivot(column, columns).agg(F.countDistinct(key)).na.fill(0)
    sums = F.lit(0).cast("long")
    for c in columns:
        sums = sums + F.col(f"`{c}`")
    return wide.withColumn(total, sums)


def trend(df: DataFrame, group: str, periods: list[str], period_col: str, value: str) -> DataFrame:
    """Mean and one deviation either side by group and period, for every period of the list."""
    grid = df.select(group).distinct().select(group, F.explode(F.array(*map(F.lit, periods))).alias(period_col))
    got = df.groupBy(group, period_col).agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    wide = grid.join(got, [group, period_col], "left")
    return wide.select(group, period_col, F.round("m", 2).alias("mean"), F.round(F.greatest(F.lit(0.0), F.col("m") - F.col("s")), 2).alias("low"), F.round(F.col("m") + F.col("s"), 2).alias("high"))


def kind_or_all(df: DataFrame, kind: str, wanted: str) -> DataFrame:
    """Rows of one kind; all rows if there are none of it."""
    there = df.agg(F.coalesce(F.max(F.col(kind) == wanted), F.lit(False)).alias("__there"))
    return df.join(F.broadcast(there)).where(~F.col("__there") | (F.col(kind) == wanted)).drop("__there")


def in_bins_or_missing(df: DataFrame, number: Column, bins: list[int], missing: bool) -> DataFrame:
    keep = number.isin(bins)
    return df.where(keep | number.isNull()) if missing else df.where(keep)


def at_levels(df: DataFrame, number: str, levels: list[float], missing: bool = False) -> DataFrame:
    """Rows whose number is exactly one of the levels; with ``missing`` also those without a number."""
    keep = F.col(number).isin([float(x) for x in levels])
    return df.where(keep | F.col(number).isNull()) if missing else df.where(keep)


#: What stands for every code of a level.
ALL = "All"


def cascade(df: DataFrame, picks: dict[str, list[str] | str | None]) -> DataFrame:
    """Rows with a picked code at each level; nothing, ``All`` or an empty list at a level picks every code. A pick may be one code or several."""
    for level, codes in picks.items():
        codes = [codes] if isinstance(codes, str) else list(codes or [])
        if codes and ALL not in codes:
            df = df.where(F.col(level).isin(codes))
    return df


def options(df: DataFrame, key: str, levels: list[str], picks: dict[str, list[str] | str | None]) -> DataFrame:
    """What can be picked at each level, given the picks of the levels above it: ``level``, ``code`` and its number of keys."""
    out = None
    for n, level in enumerate(levels, 1):
        there = cascade(df, {c: picks.get(c) for c in levels[: n - 1]})
        part = there.where(F.col(level).isNotNull()).groupBy(F.col(level).alias("code")).agg(F.countDistinct(key).alias("n")).select(F.lit(n).alias("level"), "code", "n")
        out = part if out is None else out.unionByName(part)
    return out


def pruned(df: DataFrame, levels: list[str], picks: dict[str, list[str] | str | None]) -> dict[str, list[str]]:
    """The picks without those that the levels above no longer offer. At most as many codes as are picked come to the driver."""
    out: dict[str, list[str]] = {}
    for level in levels:
        codes = picks.get(level)
        codes = [codes] if isinstance(codes, str) else list(codes or [])
        there = {r[0] for r in cascade(df, out).where(F.col(level).isin(codes)).select(level).distinct().collect()} if codes else set()
        out[level] = [c for c in codes if c == ALL or c in there]
    return out
