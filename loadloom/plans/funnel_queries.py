"""Queries of the funnel: census, coverage, completeness, consumption, power."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import binning
from ..functions.calendar import period, period_label, period_number
from ..operators import funnel
from ..operators.ranking import with_quantiles
from .frames import LINES, ORDERS, PLACES, READINGS, lines, orders, places, readings
from .registry import register

MONTHS = f"(SELECT key, count(DISTINCT strftime(ts, '%Y-%m')) AS n_months FROM {ORDERS} GROUP BY key)"
OK = f"(SELECT key FROM {MONTHS} WHERE n_months >= 12)"
STATS = "count(total) AS n, round(avg(total), 4) AS mean, round(median(total), 4) AS median, round(stddev_samp(total), 4) AS std, round(min(total), 4) AS min, round(max(total), 4) AS max"
CENSUS = """SELECT {g}, n_keys, pct, round(sum(pct) OVER (ORDER BY n_keys DESC, {g} ROWS UNBOUNDED PRECEDING), 2) AS cum_pct
FROM (SELECT {g}, n_keys, round(100.0 * n_keys / sum(n_keys) OVER (), 2) AS pct FROM (SELECT {g}, count(DISTINCT key) AS n_keys FROM {t} GROUP BY {g}))"""


@register("coverage_funnel", f"""
SELECT segment, {STATS} FROM (
  SELECT o.key, strftime(ts, '%Y-%m') AS period, sum(value) AS total FROM {ORDERS} o WHERE o.key IN {OK} GROUP BY ALL) m
JOIN {PLACES} p ON m.key = p.key GROUP BY segment""")
def coverage_funnel(spark: SparkSession, sf: str) -> DataFrame:
    """Covered keys' monthly sums, summarised by typology."""
    o = orders(spark, sf)
    monthly = funnel.monthly(o.join(funnel.covered(o, "key", "ts"), "key", "left_semi"), "key", "ts", "value")
    return funnel.summary(monthly.join(places(spark, sf), "key"), ["segment"], "total")


@register("census_by_typology", CENSUS.format(g="region, segment", t=PLACES))
def census_by_typology(spark, sf):
    return funnel.census(places(spark, sf), ["region", "segment"], "key")


@register("census_covered", CENSUS.format(g="segment", t=f"(SELECT * FROM {PLACES} WHERE key IN {OK})"))
def census_covered(spark, sf):
    """The census of covered keys alone."""
    return funnel.census(places(spark, sf).join(funnel.covered(orders(spark, sf), "key", "ts"), "key", "left_semi"), ["segment"], "key")


@register("census_by_month", f"""SELECT strftime(ts, '%Y-%m') AS period, CAST(year(ts) * 100 + month(ts) AS INT) AS period_no, strftime(ts, '%b %Y') AS label, count(DISTINCT key) AS n_keys
FROM {ORDERS} GROUP BY ALL""")
def census_by_month(spark, sf):
    n = orders(spark, sf).groupBy(period(F.col("ts")).alias("period")).agg(F.countDistinct("key").alias("n_keys"))
    return n.select("period", period_number(F.col("period")).alias("period_no"), period_label(F.col("period")).alias("label"), "n_keys")


@register("census_global", f"SELECT count(DISTINCT key) AS n_keys, count(*) AS n_rows, strftime(min(ts), '%Y-%m') AS first, strftime(max(ts), '%Y-%m') AS last FROM {ORDERS}")
def census_global(spark, sf):
    return orders(spark, sf).agg(F.countDistinct("key").alias("n_keys"), F.count(F.lit(1)).alias("n_rows"), period(F.min("ts")).alias("first"), period(F.max("ts")).alias("last"))


@register("coverage_12m", f"""SELECT count(*) AS n_keys, count(*) FILTER (n_months >= 12) AS n_covered, count(*) FILTER (n_months < 12) AS n_short,
round(100.0 * count(*) FILTER (n_months >= 12) / count(*), 2) AS pct_covered, round(100.0 * count(*) FILTER (n_months < 12) / count(*), 2) AS pct_short FROM {MONTHS}""")
def coverage_12m(spark, sf):
    return funnel.coverage(orders(spark, sf), "key", "ts")


@register("coverage_keys", f"SELECT key FROM {OK}")
def coverage_keys(spark, sf):
    return funnel.covered(orders(spark, sf), "key", "ts")


@register("coverage_bins", f"""SELECT bin_no, n, pct, bin FROM (SELECT bin_no, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct,
['<1','1-2','3-5','6-8','9-11','12-14','15-18','19+'][bin_no + 1] AS bin FROM (SELECT CAST(CASE WHEN n_months < 1 THEN 0 WHEN n_months < 3 THEN 1 WHEN n_months < 6 THEN 2 WHEN n_months < 9 THEN 3
WHEN n_months < 12 THEN 4 WHEN n_months < 15 THEN 5 WHEN n_months < 19 THEN 6 WHEN n_months < 100 THEN 7 END AS INT) AS bin_no FROM {MONTHS}) GROUP BY bin_no) WHERE bin_no IS NOT NULL""")
def coverage_bins(spark, sf):
    got = funnel.months_per_key(orders(spark, sf), "key", "ts")
    return funnel.binned(got, binning.left_closed(F.col("n_months"), binning.MONTH_EDGES), binning.MONTH_LABELS)


# A reading is taken for missing where its value ends in an odd cent: the tables have no nulls of their own.
_NULL = "CAST(floor(value * 100) AS BIGINT) % 17 = 0"
COMPLETE = f"""(SELECT key, n_rows, n_months, null_cells, cells, round(100.0 * (cells - null_cells) / cells, 4) AS completeness FROM (
SELECT key, count(*) AS n_rows, count(DISTINCT strftime(ts, '%Y-%m')) AS n_months, CAST(sum(CASE WHEN {_NULL} THEN 1 ELSE 0 END) AS BIGINT) AS null_cells, count(*) AS cells FROM {ORDERS} GROUP BY key))"""


def _completeness(spark, sf):
    missing = (F.floor(F.col("value") * 100) % 17 == 0).cast("long")
    return funnel.completeness(orders(spark, sf), "key", "ts", F.lit(1).cast("long"), missing)


@register("completeness", f"SELECT * FROM {COMPLETE}")
def completeness(spark, sf):
    return _completeness(spark, sf)


@register("completeness_bins", f"""SELECT bin_no, n, pct, ['<50%','50-80%','80-90%','90-95%','95-99%','99-99.9%','>=99.9%'][bin_no + 1] AS bin FROM (SELECT bin_no, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM (
SELECT CAST(CASE WHEN completeness <= 0 THEN NULL WHEN completeness <= 50 THEN 0 WHEN completeness <= 80 THEN 1 WHEN completeness <= 90 THEN 2 WHEN completeness <= 95 THEN 3 WHEN completeness <= 99 THEN 4
WHEN completeness <= 99.9 THEN 5 ELSE 6 END AS INT) AS bin_no FROM {COMPLETE}) GROUP BY bin_no) WHERE bin_no IS NOT NULL""")
def completeness_bins(spark, sf):
    return funnel.binned(_completeness(spark, sf), binning.right_closed(F.col("completeness"), binning.COMPLETENESS_EDGES), binning.COMPLETENESS_LABELS)


@register("completeness_overall", f"SELECT sum(cells)::BIGINT AS cells, sum(null_cells)::BIGINT AS null_cells, round(100.0 * (sum(cells) - sum(null_cells)) / sum(cells), 4) AS completeness FROM {COMPLETE}")
def completeness_overall(spark, sf):
    got = _completeness(spark, sf).agg(F.sum("cells").alias("cells"), F.sum("null_cells").alias("null_cells"))
    return got.withColumn("completeness", F.round(100.0 * (F.col("cells") - F.col("null_cells")) / F.col("cells"), 4))


MONTHLY = f"(SELECT key, strftime(ts, '%Y-%m') AS period, sum(value) AS total FROM {ORDERS} GROUP BY ALL)"


@register("monthly_totals", f"SELECT key, period, round(total, 2) AS total FROM {MONTHLY}")
def monthly_totals(spark, sf):
    return funnel.monthly(orders(spark, sf), "key", "ts", "value").withColumn("total", F.round("total", 2))


@register("monthly_by_typology", f"SELECT segment, count(DISTINCT m.key) AS n_keys, {STATS} FROM {MONTHLY} m JOIN {PLACES} p ON m.key = p.key GROUP BY segment")
def monthly_by_typology(spark, sf):
    m = funnel.monthly(orders(spark, sf), "key", "ts", "value").join(places(spark, sf), "key")
    return funnel.summary(m, ["segment"], "total").join(m.groupBy("segment").agg(F.countDistinct("key").alias("n_keys")), "segment")


_YEARS = [1995, 1996, 1997, 1998, 1999, 2000, 2001]
_CELLS = ", ".join(f'round(avg(value) FILTER (y = {y}), 2) AS "{y}"' for y in _YEARS)


@register("monthly_pivot", f"""SELECT segment, {', '.join(f'"{y}"' for y in _YEARS)}, round(list_avg(list_filter([{', '.join(f'"{y}"' for y in _YEARS)}], lambda x: x IS NOT NULL)), 2) AS mean_of_cells
FROM (SELECT segment, {_CELLS} FROM (SELECT segment, CAST(year(ts) AS INT) AS y, value FROM {ORDERS} o JOIN {PLACES} p ON o.key = p.key) GROUP BY segment)""")
def monthly_pivot(spark, sf):
    o = orders(spark, sf).withColumn("y", F.year("ts")).join(places(spark, sf), "key")
    return funnel.pivot_mean(o, "segment", "y", _YEARS, "value")


YEARLY = f"(SELECT key, y AS year, sum(t) AS total FROM (SELECT key, CAST(year(ts) AS INT) AS y, month(ts) AS m, sum(value) AS t FROM {LINES} GROUP BY ALL) GROUP BY key, y HAVING count(*) >= 12)"


@register("annual_complete_years", f"SELECT key, year, round(total, 2) AS total FROM {YEARLY}")
def annual_complete_years(spark, sf):
    return funnel.complete_years(lines(spark, sf), "key", "ts", "value").withColumn("total", F.round("total", 2))


@register("annual_summary", f"SELECT year, {STATS} FROM {YEARLY} GROUP BY year")
def annual_summary(spark, sf):
    return funnel.summary(funnel.complete_years(lines(spark, sf), "key", "ts", "value"), ["year"], "total")


_ANNUAL = " ".join(f"WHEN total / 1000 < {hi} THEN {i}" for i, hi in enumerate(binning.ANNUAL_EDGES[1:-1]))


@register("annual_bins", f"SELECT bin_no, n, pct, {binning.annual_labels()!r}[bin_no + 1] AS bin FROM (SELECT CAST(CASE {_ANNUAL} ELSE 10 END AS INT) AS bin_no, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM {YEARLY} GROUP BY bin_no)")
def annual_bins(spark, sf):
    y = funnel.complete_years(lines(spark, sf), "key", "ts", "value")
    return funnel.binned(y, binning.left_closed(F.col("total") / 1000, binning.ANNUAL_EDGES), binning.annual_labels())


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@register("annual_crosstab", f"""SELECT year, {', '.join(f'count(DISTINCT key) FILTER (segment = {s!r}) AS "{s}"' for s in _SEGMENTS)}, {' + '.join(f'count(DISTINCT key) FILTER (segment = {s!r})' for s in _SEGMENTS)} AS total
FROM (SELECT o.key, CAST(year(ts) AS INT) AS year, segment FROM {ORDERS} o JOIN {PLACES} p ON o.key = p.key) GROUP BY year""")
def annual_crosstab(spark, sf):
    o = orders(spark, sf).withColumn("year", F.year("ts")).join(places(spark, sf), "key")
    return funnel.pivot_count(o, "year", "segment", _SEGMENTS, "key")


MODE = f"(SELECT key, quantity AS mode FROM (SELECT key, quantity, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, quantity) AS rn FROM {LINES} GROUP BY key, quantity) WHERE rn = 1)"


@register("power_mode", f"SELECT * FROM {MODE}")
def power_mode(spark, sf):
    return funnel.mode_per_key(lines(spark, sf), "key", "quantity")


@register("power_stats", f"SELECT flag, count(quantity) AS n, round(avg(quantity), 4) AS mean, round(median(quantity), 4) AS median, round(min(quantity), 4) AS min, round(max(quantity), 4) AS max FROM {LINES} GROUP BY flag")
def power_stats(spark, sf):
    return funnel.summary(lines(spark, sf), ["flag"], "quantity").drop("std")


@register("power_levels", f"SELECT quantity, count(DISTINCT key) AS n_keys FROM {LINES} GROUP BY quantity")
def power_levels(spark, sf):
    return lines(spark, sf).groupBy("quantity").agg(F.countDistinct("key").alias("n_keys"))


@register("power_other_bucket", """WITH n AS (SELECT CAST(p_size AS VARCHAR) AS label, count(*) AS n FROM part GROUP BY ALL), t AS (SELECT * FROM n ORDER BY n DESC, label LIMIT 10)
SELECT * FROM t UNION ALL SELECT 'Altro', CAST(sum(n) AS BIGINT) FROM n WHERE label NOT IN (SELECT label FROM t)""")
def power_other_bucket(spark, sf):
    return funnel.top_with_other(spark.read.parquet(f"{sf}/part.parquet"), "p_size")


@register("power_pivot", f"""SELECT flag, count(DISTINCT key) FILTER (status = 'F') AS "F", count(DISTINCT key) FILTER (status = 'O') AS "O", count(DISTINCT key) FILTER (status = 'F') + count(DISTINCT key) FILTER (status = 'O') AS total FROM {LINES} GROUP BY flag""")
def power_pivot(spark, sf):
    return funnel.pivot_count(lines(spark, sf), "flag", "status", ["F", "O"], "key")


_POWER = " ".join(f"WHEN quantity <= {hi} THEN {i}" for i, hi in enumerate(binning.POWER_EDGES[1:-1]))


@register("power_bins", f"""SELECT status, {binning.POWER_LABELS!r}[b + 1] AS bin, n, round(100.0 * n / sum(n) OVER (PARTITION BY status), 2) AS pct FROM (
SELECT status, CASE WHEN quantity <= 0 THEN NULL {_POWER} ELSE 10 END AS b, count(*) AS n FROM {LINES} GROUP BY ALL)""")
def power_bins(spark, sf):
    got = lines(spark, sf).withColumn("bin", binning.label(binning.right_closed(F.col("quantity"), binning.POWER_EDGES), binning.POWER_LABELS))
    return funnel.share(got, ["status", "bin"], ["status"])


@register("power_classes", f"""SELECT CASE WHEN balance / 1000 > 0 AND balance / 1000 <= 1.5 THEN '≤ 1.5 kW' WHEN balance / 1000 > 1.5 AND balance / 1000 <= 3 THEN '1.5–3 kW' WHEN balance / 1000 > 3 AND balance / 1000 <= 4.5 THEN '3–4.5 kW'
WHEN balance / 1000 > 4.5 AND balance / 1000 <= 6 THEN '4.5–6 kW' WHEN balance / 1000 > 6 THEN '> 6 kW' END AS power_class, count(*) AS n FROM {PLACES} GROUP BY ALL""")
def power_classes(spark, sf):
    return places(spark, sf).groupBy(binning.power_class(F.col("balance") / 1000).alias("power_class")).agg(F.count(F.lit(1)).alias("n"))


@register("summary_sheet", f"""SELECT segment, count(DISTINCT m.key) AS n_keys, round(avg(total), 2) AS mean, round(median(total), 4) AS median, round(round(avg(total), 2) * 12, 0) AS annual
FROM {MONTHLY} m JOIN {PLACES} p ON m.key = p.key WHERE m.key IN {OK} GROUP BY segment""")
def summary_sheet(spark, sf):
    o = orders(spark, sf)
    m = funnel.monthly(o.join(funnel.covered(o, "key", "ts"), "key", "left_semi"), "key", "ts", "value").join(places(spark, sf), "key")
    keys = m.groupBy("segment").agg(F.countDistinct("key").alias("n_keys"))
    got = with_quantiles(m, ["segment"], "total", {"median": 0.5}, [F.avg("total").alias("mean")])
    got = keys.join(got, keys["segment"].eqNullSafe(got["segment"])).select(keys["segment"], "n_keys", F.round("mean", 2).alias("mean"), F.round("median", 4).alias("median"))
    return got.withColumn("annual", F.round(F.col("mean") * 12, 0))


@register("key_figures", f"""SELECT 'keys' AS label, CAST(count(*) AS DOUBLE) AS value FROM {MONTHS} UNION ALL SELECT 'covered', count(*) FROM {OK} UNION ALL SELECT 'rows', count(*) FROM {ORDERS}
UNION ALL SELECT 'months', count(DISTINCT strftime(ts, '%Y-%m')) FROM {ORDERS} UNION ALL SELECT 'mean', round(avg(value), 2) FROM {ORDERS}""")
def key_figures(spark, sf):
    o = orders(spark, sf)
    one = o.agg(F.countDistinct("key").alias("keys"), F.count(F.lit(1)).alias("rows"), F.countDistinct(period(F.col("ts"))).alias("months"), F.round(F.avg("value"), 2).alias("mean"))
    one = one.join(F.broadcast(funnel.coverage(o, "key", "ts").select(F.col("n_covered").alias("covered"))))
    names = ["keys", "covered", "rows", "months", "mean"]
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.col(n).cast("double").alias("value")) for n in names])).alias("x")).select("x.*")


@register("latest_dimension", f"SELECT key, ts, value, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, o_orderkey DESC) AS rn FROM {ORDERS}) WHERE rn = 1")
def latest_dimension(spark, sf):
    return funnel.latest(orders(spark, sf).drop("o_orderpriority"), "key", ["ts", "o_orderkey"])


@register("last_nonnull", f"SELECT key, max_by(value, event_id) AS value FROM {READINGS} WHERE kind = 'purchase' AND value > 20 GROUP BY key")
def last_nonnull(spark, sf):
    """The last value that counts: others are null here."""
    r = readings(spark, sf).withColumn("value", F.when((F.col("kind") == "purchase") & (F.col("value") > 20), F.col("value")))
    return funnel.last_valid(r, "key", "value", ["event_id"])


@register("topn_labels_quantiles", f"""WITH y AS (SELECT nation, total FROM (SELECT key, sum(value) AS total FROM {ORDERS} GROUP BY key) o JOIN {PLACES} p ON o.key = p.key), t AS (SELECT nation FROM y GROUP BY nation ORDER BY count(*) DESC, nation LIMIT 15)
SELECT nation, count(total) AS n, round(quantile_cont(total, 0.25), 4) AS p25, round(quantile_cont(total, 0.5), 4) AS median, round(quantile_cont(total, 0.75), 4) AS p75, round(avg(total), 4) AS mean, round(max(total), 4) AS max FROM y WHERE nation IN (SELECT nation FROM t) GROUP BY nation""")
def topn_labels_quantiles(spark, sf):
    """The 15 most frequent labels, and the facts of those alone."""
    totals = orders(spark, sf).groupBy("key").agg(F.sum("value").alias("total")).where("total > 0").join(places(spark, sf), "key")
    top = totals.groupBy("nation").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "nation").limit(15)
    return funnel.quantiles(totals.join(F.broadcast(top.select("nation")), "nation", "left_semi"), ["nation"], "total")


@register("top15_typologies", f"SELECT nation, n FROM (SELECT nation, count(*) AS n FROM {PLACES} GROUP BY nation) ORDER BY n DESC, nation LIMIT 15")
def top15_typologies(spark, sf):
    return places(spark, sf).groupBy("nation").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "nation").limit(15)


@register("kind_filter_fallback", f"SELECT 'purchase' AS wanted, count(*) AS n FROM {READINGS} WHERE kind = 'purchase' UNION ALL SELECT 'no such kind', count(*) FROM {READINGS}")
def kind_filter_fallback(spark, sf):
    """Rows of a kind, and all rows where there are none of it."""
    one = lambda k: funnel.kind_or_all(readings(spark, sf), "kind", k).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("wanted"), "n")
    return one("purchase").unionByName(one("no such kind"))


@register("bin_filter_with_missing", f"SELECT key, balance FROM {PLACES} WHERE balance <= 0 OR (balance / 1000 > 1 AND balance / 1000 <= 2)")
def bin_filter_with_missing(spark, sf):
    got = funnel.in_bins_or_missing(places(spark, sf), binning.right_closed(F.col("balance") / 1000, binning.POWER_EDGES), [1, 2], True)
    return got.select("key", "balance")


@register("set_intersect", f"SELECT key FROM {OK} INTERSECT SELECT key FROM {PLACES} WHERE region = 'ASIA'")
def set_intersect(spark, sf):
    return funnel.covered(orders(spark, sf), "key", "ts").join(places(spark, sf).where("region = 'ASIA'"), "key", "left_semi")


@register("set_except", f"SELECT key FROM {PLACES} EXCEPT SELECT key FROM {ORDERS} WHERE value > 300000")
def set_except(spark, sf):
    """Keys without an order above a value."""
    return places(spark, sf).select("key").join(orders(spark, sf).where("value > 300000"), "key", "left_anti")


@register("set_union", f"SELECT DISTINCT key FROM (SELECT key FROM {PLACES} WHERE region = 'ASIA' UNION ALL SELECT key FROM {ORDERS} WHERE value > 300000)")
def set_union(spark, sf):
    return places(spark, sf).where("region = 'ASIA'").select("key").unionByName(orders(spark, sf).where("value > 300000").select("key")).distinct()


@register("cascade_counts", f"""SELECT 1 AS level, region AS code, count(DISTINCT key) AS n FROM {PLACES} GROUP BY region UNION ALL SELECT 2, nation, count(DISTINCT key) FROM {PLACES} WHERE region IN ('ASIA', 'EUROPE') GROUP BY nation
UNION ALL SELECT 3, segment, count(DISTINCT key) FROM {PLACES} WHERE region IN ('ASIA', 'EUROPE') AND nation IN ('NATION_2', 'NATION_3') GROUP BY segment""")
def cascade_counts(spark, sf):
    """Keys behind each choice of a level, given the choices above it."""
    return funnel.options(places(spark, sf), "key", ["region", "nation", "segment"], {"region": ["ASIA", "EUROPE"], "nation": ["NATION_2", "NATION_3"]})


@register("cascade_single", f"SELECT key, nation, segment FROM {PLACES} WHERE region = 'ASIA' AND segment = 'BUILDING'")
def cascade_single(spark, sf):
    """One code a level, and every code of another."""
    return funnel.cascade(places(spark, sf), {"region": "ASIA", "nation": "All", "segment": "BUILDING"}).select("key", "nation", "segment")


@register("cascade_pruned", f"SELECT nation, count(*) AS n FROM {PLACES} WHERE region = 'ASIA' AND nation IN ('NATION_2', 'NATION_7') GROUP BY nation")
def cascade_pruned(spark, sf):
    """A pick that the level above no longer offers is dropped."""
    p = places(spark, sf)
    picks = funnel.pruned(p, ["region", "nation"], {"region": "ASIA", "nation": ["NATION_2", "NATION_3", "NATION_7"]})
    return funnel.cascade(p, picks).groupBy("nation").agg(F.count(F.lit(1)).alias("n"))


@register("exact_levels", f"SELECT key, quantity, value FROM {LINES} WHERE quantity IN (1, 3, 50) OR quantity IS NULL")
def exact_levels(spark, sf):
    return funnel.at_levels(lines(spark, sf), "quantity", [1, 3, 50], True).select("key", "quantity", "value")


@register("gap_stats", f"""SELECT key, n_days, first, last, expected, greatest(0, expected - n_days) AS missing, round(100.0 * greatest(0, expected - n_days) / expected, 2) AS missing_pct FROM (
SELECT key, count(DISTINCT ts::DATE) AS n_days, min(ts::DATE) AS first, max(ts::DATE) AS last, date_diff('day', min(ts::DATE), max(ts::DATE)) + 1 AS expected FROM {ORDERS} GROUP BY key)""")
def gap_stats(spark, sf):
    return funnel.gaps(orders(spark, sf), "key", "ts")


@register("gap_split", f"""WITH g AS (SELECT 100.0 * greatest(0, (date_diff('day', min(ts::DATE), max(ts::DATE)) + 1) - count(DISTINCT ts::DATE)) / (date_diff('day', min(ts::DATE), max(ts::DATE)) + 1) AS p FROM {READINGS} GROUP BY key)
SELECT count(*) FILTER (p > 0) AS with_gaps, count(*) FILTER (p = 0) AS without_gaps, round(avg(round(p, 2)), 2) AS mean_missing, count(*) FILTER (p > 20) AS severe FROM g""")
def gap_split(spark, sf):
    g = funnel.gaps(readings(spark, sf), "key", "ts")
    return g.agg(F.count_if(F.col("missing") > 0).alias("with_gaps"), F.count_if(F.col("missing") == 0).alias("without_gaps"), F.round(F.avg("missing_pct"), 2).alias("mean_missing"), F.count_if(F.col("missing_pct") > 20).alias("severe"))


@register("consecutive_runs", f"""WITH m AS (SELECT DISTINCT key, year(ts) * 12 + month(ts) AS m FROM {ORDERS}), i AS (SELECT key, m - row_number() OVER (PARTITION BY key ORDER BY m) AS g FROM m)
SELECT key, max(n) AS longest, max(n) >= 12 AS has_12 FROM (SELECT key, g, count(*) AS n FROM i GROUP BY key, g) GROUP BY key""")
def consecutive_runs(spark, sf):
    return funnel.runs(orders(spark, sf), "key", "ts")


@register("consumption_trend", f"""WITH p AS (SELECT DISTINCT segment FROM {PLACES}), y AS (SELECT unnest(['1995', '1996', '1997', '2050']) AS period),
a AS (SELECT segment, strftime(ts, '%Y') AS period, avg(value) AS m, stddev_samp(value) AS s FROM {ORDERS} o JOIN {PLACES} p ON o.key = p.key GROUP BY ALL)
SELECT segment, period, round(m, 2) AS mean, round(greatest(0, m - s), 2) AS low, round(m + s, 2) AS high FROM p CROSS JOIN y LEFT JOIN a USING (segment, period)""")
def consumption_trend(spark, sf):
    o = orders(spark, sf).withColumn("period", F.date_format("ts", "yyyy")).join(places(spark, sf), "key")
    return funnel.trend(o, "segment", ["1995", "1996", "1997", "2050"], "period", "value").withColumn("low", F.when(F.col("mean").isNotNull(), F.col("low")).otherwise(F.lit(0.0)))


@register("histogram", f"""WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM {ORDERS}) SELECT least(49, CAST(floor((value - lo) * 50 / (hi - lo)) AS INT)) AS bin, count(*) AS n FROM {ORDERS}, b GROUP BY ALL""")
def histogram(spark, sf):
    o = orders(spark, sf)
    edges = o.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return o.join(F.broadcast(edges)).groupBy(binning.histogram_bin(F.col("value"), F.col("lo"), F.col("hi"), 50).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@register("log_histogram", f"SELECT CAST(floor(log10(value) * 10) AS INT) AS bin, count(*) AS n FROM {ORDERS} WHERE value > 0 GROUP BY ALL")
def log_histogram(spark, sf):
    from ..functions.arrays import log10_positive

    return orders(spark, sf).where("value > 0").groupBy(F.floor(log10_positive(F.col("value")) * 10).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@register("box_stats", f"SELECT kind, count(value) AS n, round(quantile_cont(value, 0.25), 4) AS p25, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.75), 4) AS p75, round(avg(value), 4) AS mean, round(max(value), 4) AS max FROM {READINGS} GROUP BY kind")
def box_stats(spark, sf):
    return funnel.quantiles(readings(spark, sf), ["kind"], "value")


@register("heatmap_contrast", f"SELECT round(quantile_cont(m, 0.7), 2) AS p70 FROM (SELECT segment, year(ts) AS y, avg(value) AS m FROM {ORDERS} o JOIN {PLACES} p ON o.key = p.key GROUP BY ALL)")
def heatmap_contrast(spark, sf):
    m = orders(spark, sf).join(places(spark, sf), "key").groupBy("segment", F.year("ts").alias("y")).agg(F.avg("value").alias("m"))
    return m.agg(F.round(F.percentile("m", 0.7), 2).alias("p70"))


@register("estimate_annual", f"SELECT key, round(avg(total) * 12, 0) AS annual FROM {MONTHLY} GROUP BY key")
def estimate_annual(spark, sf):
    return funnel.monthly(orders(spark, sf), "key", "ts", "value").groupBy("key").agg(F.round(F.avg("total") * 12, 0).alias("annual"))


@register("kind_counts", f"SELECT kind, count(DISTINCT key) AS n_keys FROM {READINGS} GROUP BY kind")
def kind_counts(spark, sf):
    return readings(spark, sf).groupBy("kind").agg(F.countDistinct("key").alias("n_keys"))
