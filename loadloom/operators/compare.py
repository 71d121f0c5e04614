"""Likeness of profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.binning import quality
from .ranking import numbered


def pearson(a: Column, b: Column) -> Column:
    """Correlation that is null, not an error, where one side is constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def pair_metrics(df: DataFrame, groups: list[str], a: str, b: str, scale: float = 100.0, guarded: bool = True) -> DataFrame:
    """r, RMSE and MAE by group over pairs without nulls; with the guard, null unless there are two pairs or more and neither side is constant."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    d = F.col(a) - F.col(b)
    got = both.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), pearson(F.col(a), F.col(b)).alias("r"), (F.sqrt(F.avg(d * d)) * scale).alias("rmse"), (F.avg(F.abs(d)) * scale).alias("mae"),
        F.stddev_pop(a).alias("__sa"), F.stddev_pop(b).alias("__sb"),
    )
    if guarded:
        ok = (F.col("n") >= 2) & (F.col("__sa") > 0) & (F.col("__sb") > 0)
        got = got.withColumns({c: F.when(ok, F.col(c)) for c in ("r", "rmse", "mae")})
    return got.drop("__sa", "__sb")


def cv_metrics(df: DataFrame, groups: list[str], a: str, ref: str) -> DataFrame:
    """r, and RMSE and MAE as percentages of the reference's mean (0 where that isn't positive)."""
    both = df.where(F.col(a).isNotNull() & F.col(ref).isNotNull())
    d, mean = F.col(a) - F.col(ref), F.avg(ref)
    rel = lambda e: F.when(mean > 0, 100 * e / mean).otherwise(0.0)
    return both.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), pearson(F.col(a), F.col(ref)).alias("r"), rel(F.sqrt(F.avg(d * d))).alias("cv_rmse"), rel(F.avg(F.abs(d))).alias("cv_mae"))


def shape_metrics(df: DataFrame, groups: list[str], a: str, b: str) -> DataFrame:
    """Pair metrics after each side is scaled from 0 to 1 within its group."""
    w = Window.partitionBy(*groups)
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    scaled = both.withColumns({c: F.coalesce(F.try_divide(F.col(c) - F.min(c).over(w), F.max(c).over(w) - F.min(c).over(w)), F.lit(0.0)) for c in (a, b)})
    return pair_metrics(scaled, groups, a, b, 100.0, guarded=False)


def against_group(profiles: DataFrame, key: str, slots: list[str], value: str = "v") -> DataFrame:
    """Every key's profile beside the mean profile of all keys."""
    mean = profiles.groupBy(*slots).agg(F.avg(value).alias("ref"))
    return profiles.join(mean, slots)


def ranking(metrics: DataFrame, rmse: str = "rmse", name: str = "grp") -> DataFrame:
    """Ranks by RMSE, what has none last, with grades."""
    return numbered(metrics, [F.col(rmse).asc_nulls_last(), name], "rank").withColumns({"rank": F.col("rank").cast("int"), "quality": quality(F.col(rmse))})
