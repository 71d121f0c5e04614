"""Queries of profiles and of their comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, binning, calendar
from ..operators import compare, profiles
from .frames import READINGS, readings
from .registry import register

HOURLY = f"(SELECT key, CAST(month(ts) AS INT) AS month, CAST(hour(ts) AS INT) AS hour, avg(value) AS v FROM {READINGS} GROUP BY ALL)"
DAY = "(isodow(ts) - 1)"
BAND = f"CASE WHEN {DAY} = 6 THEN 'F3' WHEN {DAY} = 5 THEN CASE WHEN hour(ts) BETWEEN 7 AND 22 THEN 'F2' ELSE 'F3' END WHEN hour(ts) BETWEEN 8 AND 18 THEN 'F1' WHEN hour(ts) = 7 OR hour(ts) BETWEEN 19 AND 22 THEN 'F2' ELSE 'F3' END"
DAYTYPE = f"CASE WHEN {DAY} < 5 THEN 'Weekday' WHEN {DAY} = 5 THEN 'Saturday' ELSE 'Sunday' END"


def _hourly(spark, sf):
    return profiles.hourly(readings(spark, sf), "key", "ts", "value")


@register("hourly_profile", f"SELECT key, month, hour, round(v, 4) AS v FROM {HOURLY}")
def hourly_profile(spark, sf):
    return _hourly(spark, sf).withColumn("v", F.round("v", 4))


@register("month_slice", f"SELECT key, hour, round(v, 4) AS v FROM {HOURLY} WHERE month = 1 AND v IS NOT NULL")
def month_slice(spark, sf):
    return _hourly(spark, sf).where("month = 1 AND v IS NOT NULL").select("key", "hour", F.round("v", 4).alias("v"))


@register("overall_profile", f"SELECT key, hour, round(avg(v), 6) AS v FROM {HOURLY} GROUP BY key, hour")
def overall_profile(spark, sf):
    return profiles.overall(_hourly(spark, sf), "key").withColumn("v", F.round("v", 6))


@register("slot_means", f"""WITH e AS (SELECT key, CAST(month(ts) AS INT) AS month, CAST(hour(ts) * 4 + minute(ts) // 15 + 1 AS INT) AS slot, value AS v FROM {READINGS})
SELECT key, month, slot, printf('%02d:%02d', (slot - 1) // 4, (slot - 1) % 4 * 15) AS label, round(avg(v), 4) AS v FROM e GROUP BY key, month, slot""")
def slot_means(spark, sf):
    """Quarter-hours of a day packed into a vector, and the means of its slots."""
    r = readings(spark, sf).withColumns({"date": F.to_date("ts"), "slot": (F.hour("ts") * 4 + F.floor(F.minute("ts") / 15) + 1).cast("int")})
    # Several readings of a slot each get a vector of their own, so that all count.
    none = lambda n: F.array_repeat(F.lit(None).cast("double"), n)
    rows = r.select("key", "date", F.concat(none(F.col("slot") - 1), F.array("value"), none(96 - F.col("slot"))).alias("q"))
    got = profiles.slot_means(rows, "key", "date", "q", empty=False).where("v is not null")
    return got.select("key", "month", "slot", calendar.slot_label(F.col("slot")).alias("label"), F.round("v", 4).alias("v"))


VECTORS_SQL = "(SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0.2 THEN NULL ELSE x::DOUBLE END) AS q FROM embeddings)"


def _q(spark, sf):
    """Vectors in which values above 0.2 are missing."""
    return spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: F.when(x > 0.2, None).otherwise(x.cast("double"))).alias("q"))


@register("daily_total", f"SELECT vec_id, round(coalesce(list_sum(q), 0) / 1000, 6) AS total, len(list_filter(q, lambda x: x IS NULL)) AS n_null FROM {VECTORS_SQL}")
def daily_total(spark, sf):
    return _q(spark, sf).select("vec_id", F.round(arrays.total(F.col("q"), 1 / 1000), 6).alias("total"), arrays.nulls(F.col("q")).cast("long").alias("n_null"))


@register("quarter_to_hour", f"SELECT vec_id, CAST(h AS INT) AS hour, round(coalesce(list_sum(q[h * 4 + 1 : h * 4 + 4]), 0), 5) AS v FROM {VECTORS_SQL}, range(24) t(h)")
def quarter_to_hour(spark, sf):
    return _q(spark, sf).select("vec_id", F.posexplode(arrays.hours(F.col("q"))).alias("hour", "v")).withColumn("v", F.round("v", 5))


@register("array_minmax", f"""SELECT vec_id, i AS slot, CASE WHEN q[i + 1] IS NOT NULL THEN round(coalesce((q[i + 1] - list_min(q)) / nullif(list_max(q) - list_min(q), 0), 0), 5) END AS v FROM {VECTORS_SQL}, (SELECT CAST(range AS INT) AS i FROM range(64))""")
def array_minmax(spark, sf):
    return _q(spark, sf).select("vec_id", F.posexplode(arrays.minmax(F.col("q"))).alias("slot", "v")).withColumn("v", F.round("v", 5))


@register("tou_band", f"SELECT event_id, {BAND} AS band, {DAYTYPE} AS daytype, CAST({DAY} AS INT) AS weekday FROM {READINGS}")
def tou_band(spark, sf):
    r = readings(spark, sf)
    return r.select("event_id", calendar.band(calendar.weekday(F.col("ts")), F.hour("ts")).alias("band"), calendar.day_type(F.col("ts")).alias("daytype"), calendar.weekday(F.col("ts")).alias("weekday"))


@register("tou_band_profile", f"""WITH d AS (SELECT key, ts::DATE AS day, CAST(month(ts) AS INT) AS month, CAST(hour(ts) AS INT) AS hour, {BAND} AS band, sum(value) AS v FROM {READINGS} GROUP BY ALL),
t AS (SELECT *, sum(v) OVER (PARTITION BY key, month, band) AS t FROM d), k AS (SELECT key, month, hour, avg(CASE WHEN t > 0 THEN 100 * v / t END) AS pct FROM t GROUP BY ALL)
SELECT month, hour, round(avg(pct), 4) AS pct FROM k GROUP BY ALL""")
def tou_band_profile(spark, sf):
    return profiles.band_share(readings(spark, sf), "key", "ts", "value").withColumn("pct", F.round("pct", 4))


@register("monthly_share_profile", f"""WITH d AS (SELECT key, ts::DATE AS day, CAST(month(ts) AS INT) AS month, CAST(hour(ts) AS INT) AS hour, sum(value) AS v FROM {READINGS} GROUP BY ALL), s AS (SELECT key, month, hour, sum(v) AS s FROM d GROUP BY ALL),
m AS (SELECT key, month, count(DISTINCT day) AS days, sum(v) AS t FROM d GROUP BY ALL HAVING sum(v) > 0) SELECT month, hour, round(avg(s / days / t * 100), 6) AS pct FROM s JOIN m USING (key, month) GROUP BY ALL""")
def monthly_share_profile(spark, sf):
    return profiles.monthly_share(readings(spark, sf), "key", "ts", "value").withColumn("pct", F.round("pct", 6))


DAYTYPES = f"""(WITH k AS (SELECT key, {DAYTYPE} AS daytype, CAST(month(ts) AS INT) AS month, CAST(hour(ts) AS INT) AS hour, avg(value) AS v FROM {READINGS} GROUP BY ALL), m AS (SELECT daytype, month, hour, avg(v) AS v FROM k GROUP BY ALL)
SELECT * FROM m UNION ALL SELECT daytype, 0, hour, avg(v) FROM m GROUP BY ALL)"""


@register("daytype_profile", f"SELECT daytype, month, hour, round(v, 8) AS v FROM {DAYTYPES}")
def daytype_profile(spark, sf):
    return profiles.by_day_type(readings(spark, sf), "key", "ts", "value").withColumn("v", F.round("v", 8))


@register("reference_means", f"SELECT m.month, CAST(h AS INT) AS hour, round(v, 4) AS v FROM (SELECT DISTINCT CAST(month(ts) AS INT) AS month FROM {READINGS}) m CROSS JOIN range(24) t(h) LEFT JOIN (SELECT CAST(month(ts) AS INT) AS month, CAST(hour(ts) AS INT) AS hour, avg(value) AS v FROM {READINGS} WHERE hour(ts) <> 3 GROUP BY ALL) r ON r.month = m.month AND r.hour = h")
def reference_means(spark, sf):
    """24 rows a month, one without data."""
    r = readings(spark, sf).select(F.month("ts").alias("month"), F.hour("ts").alias("hour"), F.when(F.hour("ts") != 3, F.col("value")).alias("value"))
    return profiles.reference_means(r, "value").withColumn("v", F.round("v", 4))


@register("reference_vector", f"SELECT kind, round(list(v ORDER BY hour)[1], 5) AS first, round(sum(v), 2) AS total, count(*) AS n FROM (SELECT kind, hour(ts) AS hour, avg(value) AS v FROM {READINGS} GROUP BY ALL) GROUP BY kind HAVING count(*) = 24")
def reference_vector(spark, sf):
    h = readings(spark, sf).groupBy("kind", F.hour("ts").alias("hour")).agg(F.avg("value").alias("v"))
    got = profiles.reference_vector(h, ["kind"], "hour", "v")
    return got.select("kind", F.round(F.col("vector")[0], 5).alias("first"), F.round(arrays.total(F.col("vector")), 2).alias("total"), F.size("vector").cast("long").alias("n"))


# The cells of the year for the filling queries. Most users have no reading in most of their hours of a month.
GRID = f"""(SELECT k.key, m.month, s.slot, v FROM (SELECT DISTINCT key FROM {READINGS}) k CROSS JOIN (SELECT DISTINCT CAST(month(ts) AS INT) AS month FROM {READINGS}) m CROSS JOIN (SELECT CAST(range + 1 AS INT) AS slot FROM range(24)) s
LEFT JOIN (SELECT key, CAST(month(ts) AS INT) AS month, CAST(hour(ts) + 1 AS INT) AS slot, avg(value) AS v FROM {READINGS} GROUP BY ALL) p USING (key, month, slot))"""
FILLED = f"""(WITH g AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY slot, month) AS i FROM {GRID}), w AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS p, last_value(v IGNORE NULLS) OVER b AS pv,
first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS n, first_value(v IGNORE NULLS) OVER a AS nv FROM g WINDOW b AS (PARTITION BY key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY key ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT key, month, slot, CASE WHEN v IS NOT NULL THEN v WHEN coalesce(i - p <= 4, false) OR coalesce(n - i <= 4, false) THEN coalesce(pv + (nv - pv) * (i - p) / nullif(n - p, 0), pv, nv) END AS v FROM w)"""
LINED = f"""(WITH f AS (SELECT key, month, slot, coalesce(v, last_value(v IGNORE NULLS) OVER (PARTITION BY key, month ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS v FROM {FILLED})
SELECT key, month, slot, coalesce(v, first_value(v IGNORE NULLS) OVER (PARTITION BY key, month ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM f)"""


def _packed(spark, sf, step):
    """The hours of the year of each user as one array, and the months that there are."""
    r = readings(spark, sf)
    months = profiles.observed_months(r, F.month("ts"))
    means = r.groupBy("key", F.month("ts").alias("month"), (F.hour("ts") + 1).alias("slot")).agg(F.avg("value").alias("v"))
    return profiles.packed(means, "key", months, count=24, step=step), months


def _cells(spark, sf, step):
    dense, months = _packed(spark, sf, step)
    return profiles.unpacked(dense, "key", months, count=24)


@register("interpolate_fill", f"SELECT key, month, slot, round(v, 7) AS v FROM {FILLED}")
def interpolate_fill(spark, sf):
    return _cells(spark, sf, "interpolated").withColumn("v", F.round("v", 7))


@register("ffill_bfill", f"SELECT key, month, slot, round(v, 7) AS v FROM {LINED}")
def ffill_bfill(spark, sf):
    return _cells(spark, sf, "filled").withColumn("v", F.round("v", 7))


FULL = f"(SELECT key, month, slot, coalesce(v, median(v) OVER (PARTITION BY key), 0) AS v FROM {LINED})"
SCALED = f"(SELECT key, month, slot, v, coalesce((v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0), 0) AS norm FROM {FULL} WINDOW w AS (PARTITION BY key, month))"


@register("median_fill", f"SELECT key, month, slot, round(v, 7) AS v FROM {FULL}")
def median_fill(spark, sf):
    return _cells(spark, sf, "whole").withColumn("v", F.round("v", 7))


@register("minmax_profile", f"SELECT key, month, slot, round(norm, 5) AS norm FROM {SCALED}")
def minmax_profile(spark, sf):
    return _cells(spark, sf, "scaled").select("key", "month", "slot", F.round("norm", 5).alias("norm"))


@register("profile_matrix", f"""SELECT key, {', '.join(f'round(max(norm) FILTER (month = {m} AND slot = {s}), 5) AS "M{m:02d}_Q{s}"' for m in range(1, 13) for s in range(1, 25))} FROM {SCALED} GROUP BY key""")
def profile_matrix(spark, sf):
    """The wide form: a column for each month and hour, null in a month without data."""
    dense, months = _packed(spark, sf, "scaled")
    place = {m: 24 * i for i, m in enumerate(months)}
    cell = lambda m, s: F.round(F.col("norm")[place[m] + s - 1], 5) if m in place else F.lit(None).cast("double")
    return dense.select("key", *[cell(m, s).alias(f"M{m:02d}_Q{s}") for m in range(1, 13) for s in range(1, 25)])


@register("band_pm_sigma", f"SELECT kind, hour, round(m, 4) AS mean, round(greatest(0, m - s), 4) AS low, round(least(1, m + s), 4) AS high FROM (SELECT kind, CAST(hour(ts) AS INT) AS hour, avg(value / 500) AS m, stddev_samp(value / 500) AS s FROM {READINGS} GROUP BY ALL)")
def band_pm_sigma(spark, sf):
    got = profiles.sigma_band(readings(spark, sf).withColumns({"hour": F.hour("ts"), "v": F.col("value") / 500}), ["kind", "hour"], "v")
    return got.select("kind", "hour", *[F.round(c, 4).alias(c) for c in ("mean", "low", "high")])


PAIRED = f"(SELECT p.key, p.month, p.hour, p.v, r.ref FROM {HOURLY} p JOIN (SELECT month, hour, avg(v) AS ref FROM {HOURLY} GROUP BY ALL) r USING (month, hour))"
R = "covar_pop(v, ref) / nullif(stddev_pop(v) * stddev_pop(ref), 0)"
METRICS = f"(SELECT key, n, CASE WHEN ok THEN r END AS r, CASE WHEN ok THEN rmse END AS rmse, CASE WHEN ok THEN mae END AS mae FROM (SELECT key, count(*) AS n, {R} AS r, sqrt(avg(pow(v - ref, 2))) AS rmse, avg(abs(v - ref)) AS mae, count(*) >= 2 AND stddev_pop(v) > 0 AND stddev_pop(ref) > 0 AS ok FROM {PAIRED} GROUP BY key))"


def _paired(spark, sf):
    return compare.against_group(_hourly(spark, sf), "key", ["month", "hour"])


@register("pair_metrics", f"SELECT key, n, round(r, 5) AS r, round(rmse * 100, 3) AS rmse, round(mae * 100, 3) AS mae FROM {METRICS}")
def pair_metrics(spark, sf):
    got = compare.pair_metrics(_paired(spark, sf), ["key"], "v", "ref")
    return got.select("key", "n", F.round("r", 5).alias("r"), F.round("rmse", 3).alias("rmse"), F.round("mae", 3).alias("mae"))


@register("pair_metrics_unscaled", f"SELECT key, round(rmse, 5) AS rmse, round(mae, 5) AS mae FROM {METRICS}")
def pair_metrics_unscaled(spark, sf):
    got = compare.pair_metrics(_paired(spark, sf), ["key"], "v", "ref", scale=1.0)
    return got.select("key", F.round("rmse", 5).alias("rmse"), F.round("mae", 5).alias("mae"))


@register("cv_metrics", f"SELECT key, count(*) AS n, round({R}, 5) AS r, round(CASE WHEN avg(ref) > 0 THEN 100 * sqrt(avg(pow(v - ref, 2))) / avg(ref) ELSE 0 END, 6) AS cv_rmse, round(CASE WHEN avg(ref) > 0 THEN 100 * avg(abs(v - ref)) / avg(ref) ELSE 0 END, 6) AS cv_mae FROM {PAIRED} GROUP BY key")
def cv_metrics(spark, sf):
    got = compare.cv_metrics(_paired(spark, sf), ["key"], "v", "ref")
    return got.select("key", "n", F.round("r", 5).alias("r"), F.round("cv_rmse", 6).alias("cv_rmse"), F.round("cv_mae", 6).alias("cv_mae"))


@register("shape_metrics", f"""WITH s AS (SELECT key, coalesce((v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0), 0) AS v, coalesce((ref - min(ref) OVER w) / nullif(max(ref) OVER w - min(ref) OVER w, 0), 0) AS ref FROM {PAIRED} WINDOW w AS (PARTITION BY key))
SELECT key, round({R}, 5) AS r, round(100 * sqrt(avg(pow(v - ref, 2))), 3) AS rmse, round(100 * avg(abs(v - ref)), 3) AS mae FROM s GROUP BY key""")
def shape_metrics(spark, sf):
    got = compare.shape_metrics(_paired(spark, sf), ["key"], "v", "ref")
    return got.select("key", F.round("r", 5).alias("r"), F.round("rmse", 3).alias("rmse"), F.round("mae", 3).alias("mae"))


@register("comparison_ranking", f"""SELECT key, round(rmse, 3) AS rmse, CAST(row_number() OVER (ORDER BY rmse NULLS LAST, key) AS INT) AS rank,
CASE WHEN rmse IS NULL THEN '—' WHEN rmse < 5 THEN 'Good' WHEN rmse < 10 THEN 'Acceptable' WHEN rmse < 20 THEN 'Not Comparable' ELSE 'Very Different' END AS quality FROM (SELECT key, round(rmse, 6) AS rmse FROM {METRICS})""")
def comparison_ranking(spark, sf):
    got = compare.pair_metrics(_paired(spark, sf), ["key"], "v", "ref", scale=1.0).withColumn("rmse", F.round("rmse", 6))
    return compare.ranking(got, "rmse", "key").select("key", F.round("rmse", 3).alias("rmse"), "rank", "quality")


@register("metrics_grid", f"""WITH d AS {DAYTYPES}, r AS (SELECT month, hour, avg(v) AS ref FROM d GROUP BY ALL) SELECT daytype, d.month, count(*) AS n, round({R}, 5) AS r, round(CASE WHEN avg(ref) > 0 THEN 100 * sqrt(avg(pow(v - ref, 2))) / avg(ref) ELSE 0 END, 6) AS cv_rmse,
round(CASE WHEN avg(ref) > 0 THEN 100 * avg(abs(v - ref)) / avg(ref) ELSE 0 END, 6) AS cv_mae FROM d JOIN r USING (month, hour) GROUP BY daytype, d.month""")
def metrics_grid(spark, sf):
    """Every period by day type against the mean of the day types."""
    d = profiles.by_day_type(readings(spark, sf), "key", "ts", "value")
    got = compare.cv_metrics(compare.against_group(d, "daytype", ["month", "hour"]), ["daytype", "month"], "v", "ref")
    return got.select("daytype", "month", "n", F.round("r", 5).alias("r"), F.round("cv_rmse", 6).alias("cv_rmse"), F.round("cv_mae", 6).alias("cv_mae"))


@register("export_grid", f"""SELECT hour, {', '.join(f"round(max(v) FILTER (daytype = '{d}'), 6) AS {d}" for d in ('Weekday', 'Saturday', 'Sunday'))} FROM {DAYTYPES} WHERE month = 0 GROUP BY hour""")
def export_grid(spark, sf):
    """Hours down, day types across."""
    d = profiles.by_day_type(readings(spark, sf), "key", "ts", "value").where("month = 0")
    return d.groupBy("hour").pivot("daytype", ["Weekday", "Saturday", "Sunday"]).agg(F.round(F.max("v"), 6))


@register("quality_bands", f"SELECT CASE WHEN value < 5 THEN 'Good' WHEN value < 10 THEN 'Acceptable' WHEN value < 20 THEN 'Not Comparable' ELSE 'Very Different' END AS quality, count(*) AS n FROM {READINGS} GROUP BY ALL")
def quality_bands(spark, sf):
    return readings(spark, sf).groupBy(binning.quality(F.col("value")).alias("quality")).agg(F.count(F.lit(1)).alias("n"))


@register("group_shares", f"""WITH d AS (SELECT CAST(key % 3 AS VARCHAR) AS grp, key, ts::DATE AS day, CAST(month(ts) AS INT) AS month, CAST(hour(ts) AS INT) AS hour, sum(value) AS v FROM {READINGS} GROUP BY ALL), s AS (SELECT grp, key, month, hour, sum(v) AS s FROM d GROUP BY ALL),
m AS (SELECT key, month, count(DISTINCT day) AS days, sum(v) AS t FROM d GROUP BY ALL HAVING sum(v) > 0) SELECT grp, month, hour, round(avg(s / days / t * 100), 6) AS pct FROM s JOIN m USING (key, month) GROUP BY ALL""")
def group_shares(spark, sf):
    """Shares of the month's energy of several groups in one plan."""
    from ..operators import comparison

    r = readings(spark, sf)
    members = r.select("key", (F.col("key") % 3).cast("string").alias("grp")).distinct()
    return comparison.group_shares(r, members, "key", "grp").withColumn("pct", F.round("pct", 6))


@register("code_ranking", f"""WITH d AS (SELECT CAST(key % 3 AS VARCHAR) AS code, key, ts::DATE AS day, CAST(month(ts) AS INT) AS month, CAST(hour(ts) AS INT) AS hour, sum(value) AS v FROM {READINGS} GROUP BY ALL), s AS (SELECT code, key, month, hour, sum(v) AS s FROM d GROUP BY ALL),
m AS (SELECT key, month, count(DISTINCT day) AS days, sum(v) AS t FROM d GROUP BY ALL HAVING sum(v) > 0), p AS (SELECT code, month, hour, avg(s / days / t * 100) AS pct FROM s JOIN m USING (key, month) GROUP BY ALL),
e AS (SELECT code, 100 * sqrt(avg(pow(pct - 0.01 * hour, 2))) AS mono, 100 * sqrt(avg(pow(pct - 0.02 * hour, 2))) AS bands FROM p GROUP BY code) SELECT code, round((mono + bands) / 2, 4) AS rmse, CAST(row_number() OVER (ORDER BY mono + bands) AS INT) AS rank FROM e""")
def code_ranking(spark, sf):
    """Codes ranked by their likeness to the reference profiles that belong to them."""
    from ..operators import comparison

    r = readings(spark, sf)
    dim = r.select("key", (F.col("key") % 3).cast("string").alias("l1")).distinct()
    ref = spark.range(12 * 24).select((F.col("id") % 12 + 1).cast("int").alias("month"), F.floor(F.col("id") / 12).cast("int").alias("hour"))
    ref = ref.withColumns({c: F.col("hour") * f for c, f in (("PDMM", 0.01), ("PDMF", 0.02), ("PAUM", 0.01), ("PAUF", 0.02))})
    _, ranking = comparison.code_comparison(r, dim, ref, "key", ("l1",))
    return ranking.select("code", F.round("rmse", 4).alias("rmse"), "rank")


@register("strict_profile", f"""WITH d AS (SELECT key, CAST(month(ts) AS INT) AS month, CAST(hour(ts) + 1 AS INT) AS slot, avg(value) AS v FROM {READINGS} GROUP BY key, ts::DATE, month(ts), hour(ts)), c AS (SELECT key, month, slot, avg(v) AS v FROM d GROUP BY ALL),
g AS (SELECT k.key, m.month, s.slot, v, row_number() OVER (PARTITION BY k.key ORDER BY s.slot, m.month) AS i FROM (SELECT DISTINCT key FROM d) k CROSS JOIN (SELECT DISTINCT month FROM d) m CROSS JOIN (SELECT CAST(range + 1 AS INT) AS slot FROM range(24)) s LEFT JOIN c ON c.key = k.key AND c.month = m.month AND c.slot = s.slot),
w AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS p, last_value(v IGNORE NULLS) OVER b AS pv, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS n, first_value(v IGNORE NULLS) OVER a AS nv FROM g
WINDOW b AS (PARTITION BY key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY key ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), f AS (SELECT key, month, slot, coalesce(v, pv + (nv - pv) * (i - p) / nullif(n - p, 0), pv, nv) AS v FROM w),
r AS (SELECT *, min(v) OVER (PARTITION BY key, month) AS lo, max(v) OVER (PARTITION BY key, month) AS hi FROM f), z AS (SELECT *, min(hi - lo) OVER (PARTITION BY key) AS flat FROM r) SELECT key, month, slot, round((v - lo) / (hi - lo), 5) AS norm FROM z WHERE flat > 0""")
def strict_profile(spark, sf):
    """The older null policy, over days packed into vectors of 24."""
    from ..operators import comparison

    long = readings(spark, sf).groupBy("key", F.to_date("ts").alias("date"), F.hour("ts").alias("h")).agg(F.avg("value").alias("v"))
    h = long.groupBy("key", "date").agg(F.map_from_entries(F.collect_list(F.struct("h", "v"))).alias("m"))
    q = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: F.col("m")[i])
    got = comparison.strict_profiles(h.select("key", "date", q.alias("q")), "key", "date", "q", 24, 0)
    return got.select("key", "month", "slot", F.round("norm", 5).alias("norm"))


@register("year_vector", f"SELECT kind, round(list(v ORDER BY month, hour)[1], 5) AS first, round(list(v ORDER BY month, hour)[288], 5) AS last, round(sum(v), 2) AS total FROM (SELECT kind, month(ts) AS month, hour(ts) AS hour, avg(value) AS v FROM {READINGS} GROUP BY ALL) GROUP BY kind HAVING count(*) = 288")
def year_vector(spark, sf):
    h = readings(spark, sf).groupBy("kind", F.month("ts").alias("month"), F.hour("ts").alias("hour")).agg(F.avg("value").alias("v"))
    got = profiles.year_vector(h, ["kind"], "month", "hour", "v")
    return got.select("kind", F.round(F.col("vector")[0], 5).alias("first"), F.round(F.col("vector")[287], 5).alias("last"), F.round(arrays.total(F.col("vector")), 2).alias("total"))


GROUPED = f"(SELECT *, CASE key % 4 WHEN 0 THEN 'DO.R' WHEN 1 THEN 'DO.NR' WHEN 3 THEN 'Other' END AS grp FROM {READINGS} WHERE key % 4 <> 2)"
SHARES = f"""(WITH d AS (SELECT grp, key, ts::DATE AS day, hour(ts) AS hour, sum(value) AS v FROM {GROUPED} GROUP BY ALL), t AS (SELECT grp, key, month(day) AS month, count(DISTINCT day) AS days, sum(v) AS t FROM d GROUP BY ALL HAVING sum(v) > 0)
SELECT grp, CAST(month AS INT) AS month, CAST(hour AS INT) AS hour, avg(s / days / t * 100) AS pct FROM (SELECT grp, key, month(day) AS month, hour, sum(v) AS s FROM d GROUP BY ALL) JOIN t USING (grp, key, month) GROUP BY ALL)"""
NATIONAL = f"(SELECT CAST(month(ts) AS INT) AS month, CAST(hour(ts) AS INT) AS hour, avg(value) / 1000 AS a, max(value) / 1000 AS b FROM {READINGS} GROUP BY ALL)"


@register("national_metrics", f"""SELECT grp, month, pairing, count(*) AS n, round(covar_pop(pct, ref) / nullif(stddev_pop(pct) * stddev_pop(ref), 0), 5) AS r, round(sqrt(avg(pow(pct - ref, 2))) * 100, 4) AS rmse, round(avg(abs(pct - ref)) * 100, 4) AS mae
FROM (SELECT grp, month, 'mono' AS pairing, pct, CASE WHEN grp LIKE 'DO%' THEN a ELSE a * 2 END AS ref FROM {SHARES} JOIN {NATIONAL} USING (month, hour) UNION ALL SELECT grp, month, 'bands', pct, CASE WHEN grp LIKE 'DO%' THEN b ELSE b * 2 END FROM {SHARES} JOIN {NATIONAL} USING (month, hour)) GROUP BY ALL""")
def national_metrics(spark, sf):
    """Homes of residents, other homes and other uses against a national reference, by month and pairing."""
    from ..operators import comparison

    r = readings(spark, sf)
    k = F.col("key") % 4
    dim = r.select("key").distinct().withColumns({"l1": F.when(k < 2, "DO").when(k == 2, "IL").otherwise("47"), "l2": F.when(k == 0, "DO.R").when(k == 1, "DO.NR").otherwise("47.1")})
    reference = r.groupBy(F.month("ts").alias("month"), F.hour("ts").alias("hour")).agg((F.avg("value") / 1000).alias("PDMM"), (F.max("value") / 1000).alias("PDMF"))
    reference = reference.withColumns({"PAUM": F.col("PDMM") * 2, "PAUF": F.col("PDMF") * 2})
    got = comparison.national_metrics(comparison.group_shares(r, comparison.groups(dim), "key", "grp"), reference)
    return got.select("grp", "month", "pairing", "n", F.round("r", 5).alias("r"), F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"))


RESIDENCE = "CASE WHEN key % 3 = 0 THEN 'Residente' ELSE 'Non residente' END"
BY_RESIDENCE = f"""(WITH k AS (SELECT {RESIDENCE} AS residence, key, {DAYTYPE} AS daytype, CAST(month(ts) AS INT) AS month, CAST(hour(ts) AS INT) AS hour, avg(value) / 1000 AS v FROM {READINGS} GROUP BY ALL), m AS (SELECT residence, daytype, month, hour, avg(v) AS v FROM k GROUP BY ALL)
SELECT * FROM m UNION ALL SELECT residence, daytype, 0, hour, avg(v) FROM m GROUP BY ALL)"""
PROVINCIAL = f"""(SELECT 'Residente' AS residence, market, CASE kind WHEN 0 THEN 'Weekday' WHEN 1 THEN 'Saturday' ELSE 'Sunday' END AS daytype, CAST(m AS INT) AS month, CAST(h AS INT) AS hour, (h + 1) * f / 24 AS kwh FROM range(24) a(h), range(13) b(m), range(3) c(kind), (VALUES ('libero', 0.3), ('tutelato', 0.2)) t(market, f) WHERE m <> 5 OR h <> 7
UNION ALL SELECT 'Non residente', 'libero', 'Weekday', 0, CAST(h AS INT), 0.1 + h / 100.0 FROM range(24) a(h))"""


@register("provincial_metrics", f"""WITH f AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY residence, market, daytype, month) AS hours FROM {PROVINCIAL}) WHERE hours = 24), b AS (SELECT residence, market, daytype, month, hour, v, kwh FROM {BY_RESIDENCE} JOIN f USING (residence, daytype, month, hour)),
s AS (SELECT *, coalesce((v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0), 0) AS x, coalesce((kwh - min(kwh) OVER w) / nullif(max(kwh) OVER w - min(kwh) OVER w, 0), 0) AS y FROM b WINDOW w AS (PARTITION BY residence, market, daytype, month))
SELECT residence, market, daytype, month, count(*) AS n, round(CASE WHEN avg(kwh) > 0 THEN 100 * sqrt(avg(pow(v - kwh, 2))) / avg(kwh) ELSE 0 END, 6) AS cv_rmse, round(CASE WHEN avg(kwh) > 0 THEN 100 * avg(abs(v - kwh)) / avg(kwh) ELSE 0 END, 6) AS cv_mae, round(sqrt(avg(pow(x - y, 2))) * 100, 6) AS shape_rmse FROM s GROUP BY ALL""")
def provincial_metrics(spark, sf):
    """Homes by residence against an hourly reference by market, day type and month; a month without all hours is left out."""
    from ..operators import comparison

    r = readings(spark, sf)
    members = r.select("key").distinct().withColumn("residence", F.when(F.col("key") % 3 == 0, "Residente").otherwise("Non residente"))
    names = F.array(F.lit("Giorno feriale"), F.lit("Sabato"), F.lit("Domenica"))
    grid = spark.range(24).select(F.col("id").cast("int").alias("hour"))
    for name, values in (("month", F.sequence(F.lit(0), F.lit(12))), ("daytype", names), ("m", F.array(F.struct(F.lit("libero").alias("market"), F.lit(0.3).alias("f")), F.struct(F.lit("tutelato").alias("market"), F.lit(0.2).alias("f"))))):
        grid = grid.withColumn(name, F.explode(values))
    many = grid.where("month <> 5 OR hour <> 7").select(F.lit("Residente").alias("residence"), "m.market", "daytype", "month", "hour", ((F.col("hour") + 1) * F.col("m.f") / 24).alias("kwh"))
    one = spark.range(24).select(F.lit("Non residente").alias("residence"), F.lit("libero").alias("market"), F.lit("Giorno feriale").alias("daytype"), F.lit(0).alias("month"), F.col("id").cast("int").alias("hour"), (0.1 + F.col("id") / 100).alias("kwh"))
    energy, shape = comparison.provincial_metrics(r, members, many.unionByName(one), "key")
    keys = ["residence", "market", "daytype", "month"]
    got = energy.join(shape.select(*keys, F.round("rmse", 6).alias("shape_rmse")), keys)
    return got.select(*keys, "n", F.round("cv_rmse", 6).alias("cv_rmse"), F.round("cv_mae", 6).alias("cv_mae"), "shape_rmse")
