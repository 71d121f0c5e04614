"""Metered groups against reference profiles: by group, by code, by day type and market."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrays import hours
from ..functions.binning import power_class, quality
from ..functions.taxonomy import reference_columns
from . import compare, profiles
from .ranking import held


def hour_rows(meas: DataFrame, key: str = "pod", date: str = "date", q: str = "q") -> DataFrame:
    """Days of quarter-hours as rows of hours: ``key``, ``ts``, ``value``."""
    long = meas.select(key, date, F.posexplode(hours(F.col(q))).alias("hour", "value"))
    ts = F.make_timestamp_ntz(F.year(date), F.month(date), F.day(date), F.col("hour"), F.lit(0), F.lit(0))
    return long.select(key, ts.alias("ts"), "value")


def groups(dim: DataFrame, l1: str = "l1", l2: str = "l2") -> DataFrame:
    """The three groups of the national comparison: resident, other homes, and everything else that is metered."""
    a, b = F.col(l1), F.col(l2)
    other = ~a.startswith("DO") & ~a.startswith("IL") & (a != "N/A")
    return dim.withColumn("grp", F.when(b == "DO.R", "DO.R").when(b == "DO.NR", "DO.NR").when(other, "Other")).where("grp is not null")


def group_shares(rows: DataFrame, members: DataFrame, key: str, group: str, ts: str = "ts", value: str = "value") -> DataFrame:
    """Each hour's share of its key's energy in the month, averaged over the keys of every group at once."""
    tagged = rows.join(members.select(key, group), key)
    daily = tagged.groupBy(group, key, F.to_date(ts).alias("day"), F.hour(ts).alias("hour")).agg(F.sum(F.coalesce(F.col(value), F.lit(0.0))).alias("v"))
    hourly = daily.groupBy(group, key, F.month("day").alias("month"), "hour").agg(F.sum("v").alias("s"))
    total = daily.groupBy(group, key, F.month("day").alias("month")).agg(F.countDistinct("day").alias("days"), F.sum("v").alias("all")).where("all > 0")
    share = hourly.join(total, [group, key, "month"]).withColumn("pct", F.col("s") / F.col("days") / F.col("all") * 100)
    return share.groupBy(group, "month", "hour").agg(F.avg("pct").alias("pct"))


def national_metrics(shares: DataFrame, reference: DataFrame, group: str = "grp") -> DataFrame:
    """Metrics by group, month and pairing; the reference has ``month, hour`` and the columns PDMM, PDMF, PAUM, PAUF."""
    home = F.col(group).startswith("DO")
    refs = reference.select(F.col("month").alias("m"), F.col("hour").alias("h"), "PDMM", "PDMF", "PAUM", "PAUF")
    joined = shares.join(refs, (shares["month"] == refs["m"]) & (shares["hour"] == refs["h"]))
    pairs = F.array(F.struct(F.lit("mono").alias("pairing"), F.when(home, F.col("PDMM")).otherwise(F.col("PAUM")).alias("ref")), F.struct(F.lit("bands").alias("pairing"), F.when(home, F.col("PDMF")).otherwise(F.col("PAUF")).alias("ref")))
    long = joined.select(group, "month", "hour", "pct", F.explode(pairs).alias("p")).select(group, "month", "hour", "pct", "p.pairing", "p.ref")
    return compare.pair_metrics(long, [group, "month", "pairing"], "pct", "ref", guarded=False)


def code_metrics(rows: DataFrame, dim: DataFrame, reference: DataFrame, key: str, level_columns: tuple[str, ...] = ("l1", "l2", "l3")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every code of every level against its reference: metrics by month, metrics of the year's 12 x 24 points, and a ranking by the year's combined RMSE.

    All levels go through one plan: each key is a member of one code a level. A code has a row of the year with the metrics of both pairings, their means and a grade.
    """
    member = dim.select(key, "l1", F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.col(c).alias("code")) for n, c in enumerate(level_columns, 1)])).alias("x")).select(key, "l1", "x.level", "x.code")
    member = member.where("code is not null and code <> 'N/A'").withColumn("grp", F.concat_ws("/", "level", "code"))
    first = member.groupBy("grp").agg(F.min("level").alias("level"), F.min("code").alias("code"), F.min_by("l1", key).alias("l1"))
    first = first.withColumn("refs", reference_columns(F.col("l1"))).where("refs is not null")
    shares = group_shares(rows, member, key, "grp").join(first, "grp")
    long_ref = reference.select("month", "hour", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("ref")) for c in ("PDMM", "PDMF", "PAUM", "PAUF")])).alias("x")).select("month", "hour", "x.name", "x.ref")
    out = None
    for pairing in ("mono", "bands"):
        part = shares.withColumn("name", F.col(f"refs.{pairing}")).join(long_ref, ["month", "hour", "name"]).withColumn("pairing", F.lit(pairing))
        out = part if out is None else out.unionByName(part)
    keys = ["grp", "level", "code", "pairing"]
    monthly = compare.pair_metrics(out, [*keys, "month"], "pct", "ref")
    yearly = compare.pair_metrics(out, keys, "pct", "ref")
    of = lambda m, p: F.max(F.when(F.col("pairing") == p, F.col(m))).alias(f"{m}_{p}")
    pairings = [of(m, p) for m in ("rmse", "mae", "r") for p in ("mono", "bands")]
    annual = yearly.groupBy("grp", "level", "code").agg(F.max("n").alias("points"), *pairings, F.avg("rmse").alias("rmse"), F.avg("r").alias("r"), F.avg("mae").alias("mae"))
    size = member.groupBy("grp").agg(F.countDistinct(key).alias("n_keys"))
    annual = annual.join(size, "grp").withColumn("quality", quality(F.col("rmse")))
    return monthly, annual, compare.ranking(annual.select("grp", "level", "code", "rmse", "r", "mae"))


def code_comparison(rows: DataFrame, dim: DataFrame, reference: DataFrame, key: str, level_columns: tuple[str, ...] = ("l1", "l2", "l3")) -> tuple[DataFrame, DataFrame]:
    """The monthly metrics and the ranking of :func:`code_metrics`."""
    monthly, _, ranked = code_metrics(rows, dim, reference, key, level_columns)
    return monthly, ranked


def national_comparison(rows: DataFrame, dim: DataFrame, reference: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The three groups against the national reference: metrics by group, month and pairing, and each hour's share beside both references."""
    shares = group_shares(rows, groups(dim), key, "grp")
    home = F.col("grp").startswith("DO")
    refs = reference.select("month", "hour", "PDMM", "PDMF", "PAUM", "PAUF")
    beside = shares.join(refs, ["month", "hour"], "left").select(
        "grp", "month", "hour", "pct", F.when(home, F.col("PDMM")).otherwise(F.col("PAUM")).alias("mono"), F.when(home, F.col("PDMF")).otherwise(F.col("PAUF")).alias("bands")
    )
    return national_metrics(shares, reference), beside


#: The provincial reference's names of the two groups of homes.
RESIDENCES = {"DO.R": "Residente", "DO.NR": "Non Residente"}


def homes(dim: DataFrame, key: str, power: str, label: str) -> DataFrame:
    """``key, residence`` of homes whose contract power is of the class ``label``."""
    names = F.create_map(*[F.lit(x) for pair in RESIDENCES.items() for x in pair])
    return dim.where(power_class(F.col(power)) == label).select(key, names[F.col("l2")].alias("residence")).where("residence is not null")


def monthly_quality(monthly: DataFrame) -> DataFrame:
    """The grade of each code and month, by the mean of the pairings' RMSE."""
    return monthly.groupBy("grp", "month").agg(F.avg("rmse").alias("rmse")).withColumn("quality", quality(F.col("rmse")))


def provincial_metrics(rows: DataFrame, members: DataFrame, reference: DataFrame, key: str, scale: float = 1 / 1000) -> tuple[DataFrame, DataFrame]:
    """Energy and shape metrics by residence, market, period and day type against an hourly reference in kWh.

    ``members`` has the key and its ``residence``; the reference has ``month`` (0: the year), ``market``, ``residence``, ``daytype``,
    ``hour``, ``kwh``. Only reference groups of 24 hours count.
    """
    homes = members.where("residence is not null").select(key, "residence").distinct()
    own = profiles.by_day_type(rows.select(key, "ts", "value").join(homes, key), key, "ts", "value", scale, ("residence",))
    names = F.create_map(*[F.lit(x) for pair in (("Giorno feriale", "Weekday"), ("Sabato", "Saturday"), ("Domenica", "Sunday")) for x in pair])
    keys = ["residence", "market", "daytype", "month"]
    full = reference.withColumn("daytype", F.coalesce(names[F.col("daytype")], F.col("daytype")))
    full = full.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("__n = 24").drop("__n")
    both = own.join(full.select(*keys, "hour", "kwh"), ["residence", "daytype", "month", "hour"])
    return compare.cv_metrics(both, keys, "v", "kwh"), compare.shape_metrics(both, keys, "v", "kwh")


def cross_level(frames: dict[str, DataFrame]) -> DataFrame:
    """Correlations between the centroids (``cluster``, ``slot``, ``v``) of several levels, each pair once."""
    out = None
    for name, c in frames.items():
        part = c.select(F.concat(F.lit(f"{name}:"), F.col("cluster").cast("string")).alias("name"), "slot", "v")
        out = part if out is None else out.unionByName(part)
    a, b = out.select(F.col("name").alias("a"), "slot", F.col("v").alias("x")), out.select(F.col("name").alias("b"), "slot", F.col("v").alias("y"))
    return a.join(b, "slot").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), compare.pearson(F.col("x"), F.col("y")).alias("r"))


def strict_profiles(df: DataFrame, key: str, date: str, q: str, count: int = 96, least_months: int = 6) -> DataFrame:
    """The older rule: keys with at least ``least_months`` times the slots of values, interpolation without limit, constant months and their keys dropped."""
    means = held(profiles.slot_means(df, key, date, q, empty=False))
    months = profiles.observed_months(means, F.col("month"))
    return profiles.unpacked(profiles.packed_strict(means, key, months, count=count, least_months=least_months), key, months, count=count)
