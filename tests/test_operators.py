"""Operators against plain restatements."""

import datetime
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loadloom.operators import clustering, compare, composition, forest, funnel, linkage, profiles, ranking


def grid(spark, values, months):
    """One key's cells, slot by slot and month by month."""
    rows = [("k", m, s + 1, values[s * len(months) + i]) for s in range(len(values) // len(months)) for i, m in enumerate(months)]
    return spark.createDataFrame(rows, "key string, month int, slot int, v double")


def filled(spark, values, months=(1,)):
    got = profiles.interpolate(grid(spark, values, list(months)), "key", "slot").orderBy("slot", "month").collect()
    return [r.v for r in got]


def test_interpolation_limit(spark):
    eight = [0.0] + [None] * 8 + [9.0]
    assert filled(spark, eight) == pytest.approx(list(range(10)))
    nine = filled(spark, [0.0] + [None] * 9 + [10.0])
    assert nine[5] is None and nine[4] == pytest.approx(4) and nine[6] == pytest.approx(6)
    assert filled(spark, [None] * 5 + [2.0] + [None] * 5) == [None] + [2.0] * 9 + [None]
    assert filled(spark, [1.0, None, 3.0, None], (1, 2))[1] == pytest.approx(2.0)


@pytest.mark.parametrize("by_slot", [True, False])
def test_packed_cells_by_the_plain_rules(spark, by_slot):
    """The kernel over arrays gives what the windows over a joined grid give, step by step."""
    rng = np.random.default_rng(12)
    rows = [(k, m, s, float(rng.integers(-3, 9))) for k in range(12) for m in (2, 5, 11) for s in range(1, 13) if rng.random() < (0.02, 0.3, 0.9)[k % 3]]
    rows += [(90, 2, 3, 0.0), (91, 5, 1, None), (92, 2, 1, 4.0), (None, 2, 1, 1.0)]
    means = spark.createDataFrame(rows, "key int, month int, slot int, v double")
    months = profiles.observed_months(means, F.col("month"))
    assert months == [2, 5, 11]
    grid = profiles.complete_grid(means.where("key is not null"), "key", "slot", 12)
    lined = profiles.interpolate(grid, "key", "slot", 3, by_slot)
    filled = profiles.fill_within_month(lined, "key", "slot")
    whole = profiles.drop_all_zero(profiles.fill_with_median(filled, "key"), "key")
    scaled = profiles.minmax(whole, ["key", "month"])
    for step, want in zip(profiles.STEPS, (lined, filled, whole, scaled), strict=True):
        dense = profiles.packed(means, "key", months, count=12, step=step, limit=3, by_slot=by_slot)
        got = profiles.unpacked(dense, "key", months, count=12)
        columns = ["key", "month", "slot", *[c for c in ("v", "norm") if c in got.columns]]
        plain = lambda d: {tuple(r)[:3]: tuple(r)[3:] for r in d.select(*columns).collect()}
        a, b = plain(got), plain(want)
        assert a.keys() == b.keys()
        for k in a:
            assert [x is None for x in a[k]] == [x is None for x in b[k]] and [x for x in a[k] if x is not None] == pytest.approx([x for x in b[k] if x is not None])
    assert profiles.packed(means.limit(0), "key", [1, 2], count=12).count() == 0
    plan = profiles.packed(means, "key", months, count=12)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan and "Join" not in plan


def test_daily_profiles(spark):
    day = datetime.date(2025, 1, 1)
    rows = [("a", day, [float(i) for i in range(96)]), ("zero", day, [0.0] * 96), ("flat", day, [5.0] * 96), (None, day, [1.0] * 96)]
    df = spark.createDataFrame(rows, "key string, date date, q array<double>")
    got = profiles.daily_profiles(df, "key", "date", "q").toPandas()
    assert set(got["key"]) == {"a", "flat"} and got["norm"].between(0, 1).all()
    assert (got[got["key"] == "flat"]["norm"] == 0).all() and got[(got["key"] == "a") & (got["slot"] == 96)]["norm"].iloc[0] == 1


def test_monthly_share_sums_to_the_day(spark):
    ts = [datetime.datetime(2025, 1, d, h) for d in range(1, 11) for h in range(24)]
    df = spark.createDataFrame([("a", t, float(t.hour + 1)) for t in ts], "key string, ts timestamp_ntz, v double")
    assert profiles.monthly_share(df, "key", "ts", "v").agg(F.sum("pct")).first()[0] * 10 == pytest.approx(100)
    assert profiles.band_share(df, "key", "ts", "v").agg(F.sum("pct")).first()[0] * 10 == pytest.approx(300, rel=0.5)


def test_shares_by_year(spark):
    """A year's shares are those of its rows alone."""
    rng = np.random.default_rng(13)
    rows = [(k, datetime.datetime(y, m, d, h), float(rng.random())) for k in "ab" for y in (2023, 2024) for m in (1, 6) for d in (3, 4, 8) for h in range(24)]
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, v double")
    for share in (profiles.monthly_share, profiles.band_share):
        got = {(r.year, r.month, r.hour): r.pct for r in share(df, "key", "ts", "v", by_year=True).collect()}
        want = {(y, r.month, r.hour): r.pct for y in (2023, 2024) for r in share(df.where(F.year("ts") == y), "key", "ts", "v").collect()}
        assert got.keys() == want.keys() and len(got) == 96 and all(got[k] == pytest.approx(want[k]) for k in got)


def test_pair_metrics_guard(spark):
    rows = [("c", 1.0, 2.0), ("c", 1.0, 3.0), ("one", 1.0, 2.0), ("ok", 1.0, 1.0), ("ok", 2.0, 3.0), ("ok", None, 9.0)]
    got = {r.g: r for r in compare.pair_metrics(spark.createDataFrame(rows, "g string, a double, b double"), ["g"], "a", "b").collect()}
    assert got["c"].r is None and got["one"].rmse is None
    assert got["ok"].r == pytest.approx(1) and got["ok"].rmse == pytest.approx(100 * np.sqrt(0.5)) and got["ok"].n == 2


def test_runs_mode_gaps(spark):
    months = ["2024-01", "2024-02", "2024-03", "2024-12", "2025-01"]
    df = spark.createDataFrame([("a", datetime.datetime.fromisoformat(m + "-05")) for m in months] + [(None, None)], "key string, ts timestamp_ntz")
    assert [(r.longest, r.has_12) for r in funnel.runs(df, "key", "ts").collect()] == [(3, False)]
    modes = spark.createDataFrame([("a", v) for v in (3, 3, 1, 1, 2)], "key string, v int")
    assert funnel.mode_per_key(modes, "key", "v").first()["mode"] == 1
    g = funnel.gaps(df, "key", "ts").first()
    assert (g.n_days, g.expected, g.missing) == (5, 367, 362)


def naive_average(x):
    clusters = {i: [i] for i in range(len(x))}
    d = linkage.distances(x)
    heights = []
    while len(clusters) > 1:
        h, a, b = min((np.mean([d[i, j] for i in clusters[a] for j in clusters[b]]), a, b) for a in clusters for b in clusters if a < b)
        heights.append(h)
        clusters[a] += clusters.pop(b)
    return sorted(heights)


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000), st.integers(2, 14))
def test_linkage(seed, n):
    x = np.random.default_rng(seed).normal(size=(n, 3))
    z = linkage.average(x)
    assert np.allclose(z[:, 2], naive_average(x)) and (np.diff(z[:, 2]) >= -1e-9).all() and z[-1, 3] == n
    s = linkage.single(x)
    assert (np.diff(s[:, 2]) >= 0).all()
    for k in range(1, n + 1):
        assert len(set(linkage.cut(z, k))) <= k
    shuffled = np.random.default_rng(seed).permutation(n)
    assert np.allclose(linkage.single(x[shuffled])[:, 2], s[:, 2])


@pytest.mark.parametrize("n, width", [(900, 3), (900, 24)])
def test_linkage_beyond_the_square(monkeypatch, n, width):
    """More points than a square of distances is held for: the same tree, in less memory than the square."""
    x = np.random.default_rng(n + width).random((n, width))
    x[1:5] = x[0]
    want = linkage.average(x), linkage.single(x)
    for name, number in (("TABLE", 150), ("TILE", 32), ("STRIP", 16)):
        monkeypatch.setattr(linkage, name, number)
    tracemalloc.start()
    got = linkage.average(x), linkage.single(x)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8 * n * n / 2
    for a, b in zip(got, want, strict=True):
        assert np.allclose(a[:, 2], b[:, 2]) and (a[4:, 3] == b[4:, 3]).all()
        for k in (2, 5, 30):
            assert (linkage.cut(a, k) == linkage.cut(b, k)).all()
    cuts = [linkage.cut(want[0], k) for k in (3, 8)]
    for labels, sums in zip(cuts, linkage.sums_by_cluster(x, cuts), strict=True):
        assert linkage.silhouette_of_sums(sums, labels) == pytest.approx(linkage.silhouette(linkage.distances(x), labels))
        assert linkage.dispersion_of_sums(sums, labels) == pytest.approx(linkage.dispersion(x, labels))


def test_large_sets_take_few_passes_over_their_pairs(monkeypatch):
    """Most merges come from a list of the nearest pairs; taking only clusters that are each other's nearest went over all pairs of points seven times here."""
    x = np.random.default_rng(21).random((1500, 8))
    want, tiles, passes = linkage.average(x), linkage._tiles, []
    for name, number in (("TABLE", 400), ("TILE", 64), ("STRIP", 32)):
        monkeypatch.setattr(linkage, name, number)
    monkeypatch.setattr(linkage, "_tiles", lambda *a: passes.append(len(a)) or tiles(*a))
    got = linkage.average(x)
    assert (got[:, [0, 1, 3]] == want[:, [0, 1, 3]]).all() and np.allclose(got[:, 2], want[:, 2])
    assert len(passes) <= 3


@pytest.mark.parametrize("looked_up, listed", [(0, 40), (3, 40), (1000, 2), (1000, 10_000)])
def test_sweeps_may_end_early(monkeypatch, looked_up, listed):
    """Sweeps that may look up nothing, or little, that list few pairs or all of them: the same merges. Dense and thin parts, equal points."""
    rng = np.random.default_rng(looked_up + listed)
    x = np.concatenate([rng.normal(size=(300, 3)) * 0.01, rng.normal(size=(200, 3)) + 4, rng.normal(size=(40, 3)) * 50])
    x = np.concatenate([x, x[::7], x[::7], x[:3]])
    want = linkage.average(x)
    for name, number in (("TABLE", 60), ("TILE", 32), ("STRIP", 16), ("LOOKED_UP", looked_up), ("LISTED", listed)):
        monkeypatch.setattr(linkage, name, number)
    got = linkage.average(x)
    assert np.allclose(got[:, 2], want[:, 2]) and (got[got[:, 2] > 0, 3] == want[want[:, 2] > 0, 3]).all()
    for k in (2, 5, 30, 200):
        assert (linkage.cut(got, k) == linkage.cut(want, k)).all()


def test_pairs_of_one_distance_are_merged(monkeypatch):
    """More pairs of the least distance than a sweep lists: it lists none, and the nearest clusters are merged instead."""
    monkeypatch.setattr(linkage, "TABLE", 20)
    x = np.stack(np.meshgrid(np.arange(16.0), np.arange(16.0)), axis=-1).reshape(-1, 2)
    for listed in (1, 40):
        monkeypatch.setattr(linkage, "LISTED", listed)
        z = linkage.average(x)
        assert len(z) == 255 and z[-1, 3] == 256 and (np.diff(z[:, 2]) >= 0).all() and z[0, 2] == 1
        assert linkage.dispersions(z, [3, 9]) == pytest.approx([linkage.dispersion(x, linkage.cut(z, k)) for k in (3, 9)])


@pytest.mark.parametrize("shift, listed", [(0, 400), (0, 50_000), (1e4, 400)])
def test_rough_sweeps_hide_no_pair(shift, listed):
    """A sweep in single precision lists every pair below its bound, of points and of clusters, by the exact distance; where rounding hides too much it lists none, and a full sweep does."""
    rng = np.random.default_rng(22)
    x = np.concatenate([rng.normal(size=(290, 4)), rng.normal(size=(10, 4)) + shift])
    for number in (300, 100):
        cluster = np.arange(300) % number
        want = {(i, j): linkage.apart(x[cluster == i], x[cluster == j]).mean() for i in range(number) for j in range(i)}
        got = linkage._short_by_points(x, np.ones(300), cluster, listed)
        if shift:
            assert got is None
            continue
        one, other, far, bound = got
        below = {pair for pair, d in want.items() if d < bound * (1 - 1e-12)}
        assert below == set(zip(one.tolist(), other.tolist())) and below
        assert far == pytest.approx([want[pair] for pair in zip(one.tolist(), other.tolist())])


def test_tens_of_thousands_of_points_fill_no_disk(spark, monkeypatch):
    """More points than single linkage has in a task: rounds would shuffle each point as often as there are blocks, and write tables of all points by round."""
    monkeypatch.setattr(forest, "average", lambda points: pytest.fail("rounds of jobs"))
    monkeypatch.setattr(clustering, "REFERENCES", 1)
    rng = np.random.default_rng(23)
    assert clustering.LOCAL_SINGLE == 20_000
    got = clustering.gap_table(vectors(spark, {"g": rng.normal(size=(20_100, 2))}), "grp", "key", "features")
    assert sorted(r.k for r in got.collect()) == list(range(3, 11))


def test_groups_of_thousands_take_no_rounds_of_jobs(spark, monkeypatch):
    """A group of over 3,000 points is one task's work: the jobs of rounds over blocks fill the driver and take minutes."""
    monkeypatch.setattr(forest, "average", lambda points: pytest.fail("rounds of jobs"))
    monkeypatch.setattr(linkage, "TABLE", 1000)
    x = np.random.default_rng(4).random((3100, 2))
    got = clustering.merges(vectors(spark, {"g": x}), "grp", "key", "features").orderBy("step").toPandas()
    monkeypatch.undo()
    assert np.allclose(got["distance"], linkage.average(x)[:, 2])


def test_heights_of_thousands_are_clustered_once(spark, monkeypatch):
    monkeypatch.setattr(forest, "average", lambda points: pytest.fail("rounds of jobs"))
    x = np.random.default_rng(6).random((3100, 2))
    asked = spark.sparkContext.accumulator(0)
    plain = linkage.average

    def counted(x):
        asked.add(1)
        return plain(x)

    monkeypatch.setattr(linkage, "average", counted)
    # The kernel refers to the function by its module, which workers import anew: it is handed over by its name here.
    monkeypatch.setattr(clustering, "linkage", type("", (), {"average": staticmethod(counted), "single": linkage.single}))
    got = clustering.cut_heights(vectors(spark, {"g": x}), "grp", "key", "features", 4).collect()
    assert [r.height for r in got] == [pytest.approx(linkage.cut_height(plain(x), 4))] and asked.value == 1


def test_votes_of_thousands_take_no_rounds_of_jobs(spark, monkeypatch):
    """Nor do the votes over such a group and its reference sets, or its clusters with the k that they choose."""
    monkeypatch.setattr(forest, "average", lambda points: pytest.fail("rounds of jobs"))
    monkeypatch.setattr(clustering, "REFERENCES", 1)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(775, 2)) + c for c in ([0, 0], [40, 0], [0, 40], [40, 40])])
    df = vectors(spark, {"g": x})
    assert clustering.gap_table(df, "grp", "key", "features").count() == 8
    got = clustering.assign(df, "grp", "key", "features").groupBy("k", "cluster").count().collect()
    assert sorted((r.k, r["count"]) for r in got) == [(4, 775)] * 4


def test_chosen_clusters_are_those_that_were_scored(spark, monkeypatch):
    """The clusters of the k that a group chooses come from the clustering that was scored, and are those of a cut into that k."""
    rng = np.random.default_rng(24)
    df = vectors(spark, {"a": rng.normal(size=(40, 2)), "b": rng.normal(size=(12, 3)), "few": rng.normal(size=(4, 2))})
    plain = clustering._cut_of
    monkeypatch.setattr(clustering, "_cut_of", lambda *a: pytest.fail("clustered again"))
    got = {(r.grp, r.key): (r.cluster, r.k) for r in clustering.assign(df, "grp", "key", "features").collect()}
    monkeypatch.setattr(clustering, "_cut_of", plain)
    assert {g for g, _ in got} == {"a", "b"}
    for k in {k for _, k in got.values()}:
        want = {(r.grp, r.key): (r.cluster, k) for r in clustering.assign(df, "grp", "key", "features", k).collect()}
        assert all(want[at] == v for at, v in got.items() if v[1] == k)


def test_equal_points_are_clustered_once(monkeypatch):
    """Copies of a point stand in for it by their number: a table of the distinct ones is all that is made, and merges of copies come by the smaller members."""
    x = np.random.default_rng(11).random((40, 3))
    many = np.repeat(x, np.arange(1, 41), axis=0)[np.random.default_rng(12).permutation(820)]
    sizes = []
    plain = linkage.merges_by_average
    monkeypatch.setattr(linkage, "merges_by_average", lambda d, size: sizes.append(len(d)) or plain(d, size))
    got = linkage.average(many)
    assert sizes == [40] and (got[:780, 2] == 0).all() and got[-1, 3] == 820
    d = linkage.distances(many)
    np.fill_diagonal(d, np.inf)
    assert np.allclose(got[:, 2], sorted(m[2] for m in plain(d, np.ones(820))))
    assert linkage.average(np.array([[1.0], [2.0], [2.0], [1.0], [1.0]]))[:3].tolist() == [[0, 3, 0, 2], [4, 5, 0, 3], [1, 2, 0, 2]]


def test_dispersions_come_from_the_merges(spark, monkeypatch):
    """No pass over the pairs of a reference set, and none of its points shuffled: the task makes them as the column functions do."""
    rng = np.random.default_rng(13)
    for n in (5, 60, 200):
        x = np.round(rng.normal(size=(n, 2)), 1)
        z, ks = linkage.average(x), linkage.candidates(n)
        assert linkage.dispersions(z, ks) == pytest.approx([linkage.dispersion(x, linkage.cut(z, k)) for k in ks])
    rows = vectors(spark, {"g": rng.normal(size=(30, 3))}).withColumn("id", F.row_number().over(Window.orderBy("key")))
    rows = rows.select("grp", "key", "features", "id")
    want = {(r.ref, r.place): list(r.features) for r in clustering.with_references(rows, 3).where("ref >= 0").collect()}
    sets = clustering._with_boxes(rows, 3).where("ref >= 0").collect()
    assert len(sets) == 3
    for s in sets:
        made = clustering._reference_points(s.ref, s.n, np.array(s.lo), np.array(s.hi))
        assert made.tolist() == [want[s.ref, i] for i in range(30)]


def test_sets_hardly_ever_share_a_task(spark, monkeypatch):
    """Sets that are worth a task each are dealt over sixteen times as many: of 55, a task gets two now and then, hardly ever three."""
    monkeypatch.setattr(clustering, "PAIRS", 1)
    rows = vectors(spark, {g: np.ones((2, 1)) for g in "abcde"})
    assert clustering._dealt(rows, rows, "grp", sets=11).rdd.getNumPartitions() == 880


def test_cut_with_equal_heights():
    x = np.array([[0.0], [0.0], [0.0], [5.0]])
    assert len(set(linkage.cut(linkage.average(x), 3))) == 2


def test_assign_and_outliers(spark):
    rng = np.random.default_rng(0)
    rows = [("g", f"{c}{i}", (rng.normal(size=4) * 0.05 + 10 * c).tolist()) for c in range(3) for i in range(8)] + [("g", "far", [99.0] * 4)] + [("few", str(i), [1.0] * 4) for i in range(4)]
    df = spark.createDataFrame(rows, "grp string, key string, f array<double>")
    got = clustering.assign(df, "grp", "key", "f", 4).toPandas()
    assert set(got["grp"]) == {"g"} and got["cluster"].nunique() == 4
    assert got.groupby("cluster")["key"].apply(lambda s: len({k[0] for k in s})).max() == 1
    assert [r.key for r in clustering.outliers(df, "grp", "key", "f", 4, 5).collect()] == ["far"]
    assert {r.method for r in clustering.vote_table(df, "grp", "key", "f").collect()} >= {"silhouette", "elbow", "gap", "chosen"}


def test_validity_in_sql_and_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 5))
    labels = rng.integers(0, 3, 40)
    df = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(labels, x))], "key long, cluster int, f array<double>")
    long = composition.long_form(df, "key", "cluster", "f")
    assert composition.calinski_harabasz(long).first()["calinski_harabasz"] == pytest.approx(linkage.calinski_harabasz(x, labels))
    assert composition.davies_bouldin(long).first()["davies_bouldin"] == pytest.approx(linkage.davies_bouldin(x, labels))
    assert composition.silhouette(df, "key", "cluster", "f").first()["silhouette"] == pytest.approx(linkage.silhouette(linkage.distances(x), labels))


def test_pearson_p():
    assert composition.pearson_p(0.0, 10) == pytest.approx(1.0)
    assert composition.pearson_p(0.632, 10) == pytest.approx(0.05, abs=2e-3)  # the tabulated 5 % point
    assert composition.pearson_p(0.765, 10) == pytest.approx(0.01, abs=1e-3)
    assert composition.pearson_p(1.0, 10) == 0.0


def test_partition_invariance(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"key": rng.integers(0, 5, 300), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 8000, 300), unit="h"), "v": rng.normal(size=300)})
    df = spark.createDataFrame(pdf)
    a, b = (funnel.monthly(d, "key", "ts", "v").orderBy("key", "period").toPandas() for d in (df.coalesce(1), df.repartition(7)))
    pd.testing.assert_frame_equal(a, b)


def test_provincial_metrics_of_every_residence(spark):
    from loadloom.operators import comparison

    n = 120
    rows = spark.range(n * 24).select((F.col("id") / 24).cast("long").alias("pod"), F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, cast(id % 24 as int))").alias("ts"), (F.col("id") % 24 * 1000.0).alias("value"))
    members = spark.range(n).select(F.col("id").alias("pod"), F.concat(F.lit("r"), "id").alias("residence"))
    reference = members.crossJoin(spark.range(24).select(F.col("id").cast("int").alias("hour"))).select(F.lit(1).alias("month"), F.lit("m").alias("market"), "residence", F.lit("Giorno feriale").alias("daytype"), "hour", F.col("hour").cast("double").alias("kwh"))
    for got in comparison.provincial_metrics(rows, members, reference, "pod"):
        assert {r.residence for r in got.collect()} == {f"r{i}" for i in range(n)}


def test_breakdown_has_every_cluster(spark, monkeypatch):
    from loadloom.sources import reports

    seen = []
    monkeypatch.setattr(reports.composition, "crosstab_text", lambda df, row, column, columns: seen.extend(columns))
    monkeypatch.setattr(reports.store, "bundle", lambda *a: b"")
    pods = spark.range(1001).select(F.col("id").alias("pod"), F.col("id").cast("int").alias("cluster"))
    long = pods.select(F.col("pod").alias("key"), "cluster", F.lit(0).alias("slot"), F.lit(1.0).alias("v"))
    reports.clustering_bundle(pods, long, pods.select("pod", F.lit("x").alias("code")), "code")
    assert seen == list(range(1001))


def test_outlier_queries_use_the_operators_defaults(spark, monkeypatch):
    from loadloom.plans import cluster_queries

    seen = []
    monkeypatch.setattr(cluster_queries, "_profiles", lambda *a: None)
    monkeypatch.setattr(cluster_queries, "_by_least_key", lambda df: df)
    monkeypatch.setattr(cluster_queries, "readings", lambda *a: spark.range(1).withColumnRenamed("id", "key"))
    monkeypatch.setattr(cluster_queries.clustering, "outlier_report", lambda *a: None)
    monkeypatch.setattr(cluster_queries.clustering, "outliers", lambda *a, k=20, below=5: seen.append((k, below)))
    cluster_queries.outliers_single_linkage(spark, "")
    cluster_queries.outlier_report(spark, "")
    assert seen == [(20, 5)] * 2


def test_elbow(spark):
    cases = {"first that has a drop": ([3, 4, 5], [10.0, 5.0, 2.5], 4), "below the mean": ([2, 3, 4, 5], [100.0, 60.0, 50.0, 30.0], 4), "after zero": ([2, 3, 4, 5], [8.0, 0.0, 0.0, 0.0], 3), "all zero": ([2, 3, 4], [0.0, 0.0, 0.0], None), "two": ([2, 3], [2.0, 1.0], None)}
    for ks, values, want in cases.values():
        assert linkage.elbow(ks, values) == want
        assert composition.elbow(spark.createDataFrame(list(zip(ks, values)), "k int, inertia double")).first()[0] == want


def test_distance_sums_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(composition, "BLOCK", 7)
    rng = np.random.default_rng(3)
    x, labels = rng.normal(size=(30, 4)), rng.integers(0, 3, 30)
    df = spark.createDataFrame([(f"k{i}", f"c{c}", v.tolist()) for i, (c, v) in enumerate(zip(labels, x))] + [("none", "c0", None)], "key string, cluster string, f array<float>")
    d = linkage.distances(x.astype(np.float32).astype(float))
    got = {(r.ka, r.cb): (r.s, r.n) for r in composition.distance_sums(df, "key", "cluster", "f").collect()}
    for i in range(30):
        for c in range(3):
            assert got[f"k{i}", f"c{c}"] == (pytest.approx(d[i, labels == c].sum(), abs=1e-6), (labels == c).sum())
    mean = {r.cluster: r.mean_distance for r in composition.mean_distances(df, "key", "cluster", "f").collect()}
    for c in range(3):
        own = d[np.ix_(labels == c, labels == c)]
        assert mean[f"c{c}"] == pytest.approx(own.sum() / (len(own) * (len(own) - 1)))
    assert composition.silhouette(df.limit(0), "key", "cluster", "f").first()["n"] == 0


def test_ranking_without_one_task(spark):
    rng = np.random.default_rng(4)
    rows = [(f"g{i:04d}", None if i % 17 == 0 else float(rng.integers(0, 200))) for i in range(3000)]
    got = {r.grp: r["rank"] for r in compare.ranking(spark.createDataFrame(rows, "grp string, rmse double")).collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    assert got == {g: i for i, (g, _) in enumerate(want, 1)}


def test_numbers_of_ties(spark):
    """Nine of ten rows have one value; ranks are those of a window, over all and by group."""
    df = spark.range(20_000).select("id", F.when(F.col("id") % 10 < 9, 1.0).when(F.col("id") % 100 != 9, F.rand(1)).alias("v"), (F.col("id") % 3).alias("g"))
    df = ranking.held(df)
    order = [F.col("v").asc_nulls_last(), F.col("id")]
    for by in (None, "g"):
        w = Window.partitionBy(by).orderBy(*order) if by else Window.orderBy(*order)
        want = {r.id: r.n for r in df.select("id", F.row_number().over(w).alias("n")).collect()}
        assert {r.id: r.n for r in ranking.numbered(df, order, "n", by).collect()} == want
    assert ranking.numbered(df.limit(0), ["id"], "n").count() == 0


def test_quantiles_of_a_hot_group(spark, monkeypatch, tmp_path):
    """One group holds nine of ten rows: the same digits as the built-in function, and no task has more than its range of the values."""
    monkeypatch.setattr(ranking, "SMALL", 10)
    folder, plain = str(tmp_path), ranking._running

    def counted(batches):
        from pyspark import TaskContext

        rows = list(batches)
        with open(f"{folder}/{TaskContext.get().partitionId()}", "w") as f:
            f.write(str(sum(b.num_rows for b in rows)))
        yield from plain(iter(rows))

    monkeypatch.setattr(ranking, "_running", counted)
    df = spark.range(20_000).select(
        F.when(F.col("id") % 10 > 0, F.lit("hot")).when(F.col("id") % 50 == 0, None).otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"),
        F.when(F.col("id") % 11 == 0, None).when(F.col("id") % 3 == 0, 5.0).otherwise(F.round(F.rand(2) * 1000, 2)).alias("v"),
    ).unionByName(spark.createDataFrame([("none", None), ("one", 2.5)], "g string, v double"))
    df = ranking.held(df)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which joins small ranges
    try:
        got = {r.g: tuple(r)[1:] for r in funnel.quantiles(df, ["g"], "v").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    p = F.percentile("v", [0.25, 0.5, 0.75])
    want = df.groupBy("g").agg(F.count("v").alias("n"), p.alias("p"), F.round(F.avg("v"), 4).alias("m"), F.max("v").alias("x")).collect()
    assert got == {r.g: (r.n, *([round(x, 4) for x in r.p] if r.p else [None] * 3), r.m, r.x) for r in want} and len(got) == 11
    tasks = [int(f.read_text()) for f in tmp_path.iterdir()]
    assert sum(tasks) == df.where("v is not null").distinct().count() and max(tasks) < 0.5 * sum(tasks)
    two = funnel.summary(df.withColumn("h", F.col("v") > 500), ["g", "h"], "v")
    assert {(r.g, r.h): r["median"] for r in two.collect()} == {(r.g, r.h): None if r.m is None else round(r.m, 4) for r in df.withColumn("h", F.col("v") > 500).groupBy("g", "h").agg(F.median("v").alias("m")).collect()}


def test_cascades(spark):
    df = spark.createDataFrame([(1, "A", "A.1"), (2, "A", "A.2"), (3, "B", "B.1"), (4, None, None)], "key int, l1 string, l2 string")
    keys = lambda picks: sorted(r.key for r in funnel.cascade(df, picks).collect())
    assert keys({}) == keys({"l1": "All"}) == keys({"l1": []}) == [1, 2, 3, 4] and keys({"l1": "A", "l2": ["A.2", "B.1"]}) == [2]
    assert funnel.pruned(df, ["l1", "l2"], {"l1": ["A", "Z"], "l2": ["A.2", "B.1", "All"]}) == {"l1": ["A"], "l2": ["A.2", "All"]}
    assert {(r.level, r.code, r.n) for r in funnel.options(df, "key", ["l1", "l2"], {"l1": "B"}).collect()} == {(1, "A", 2), (1, "B", 1), (2, "B.1", 1)}
    assert [r.key for r in funnel.at_levels(df, "key", [2, 9]).collect()] == [2]


def test_planted_gaps(spark):
    """Cells taken out of a full grid come back on the line between their neighbours, within the limit."""
    whole = [float(3 * i) for i in range(48)]
    holes = {5, 6, 20, 21, 22, 23, 40}
    got = filled(spark, [None if i in holes else v for i, v in enumerate(whole)], (1, 2))
    assert got == pytest.approx(whole)


def test_cut_heights(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(9, 3))
    df = spark.createDataFrame([("g", f"k{i}", v.tolist()) for i, v in enumerate(x)], "grp string, key string, f array<double>")
    for k in (2, 4, 8):
        got = clustering.cut_heights(df, "grp", "key", "f", k).first()
        assert got.height == pytest.approx(linkage.cut_height(linkage.average(x), k))


def python_uniform(c):
    one = (c * 48_271 + 12_345) % 2_147_483_647
    two = (one * one + c) % 2_147_483_647
    three = (two * 69_621 + one) % 2_147_483_647
    return ((three * three + two) % 2_147_483_647) / 2_147_483_647.0


def log_dispersion(points, labels):
    total = 0.0
    for c in set(labels.tolist()):
        own = points[labels == c]
        total += sum(np.linalg.norm(p - q) for i, p in enumerate(own) for q in own[:i]) / len(own)
    return np.log(total)


def vectors(spark, sets):
    return spark.createDataFrame([(g, f"k{i:05d}", v.tolist()) for g, x in sets.items() for i, v in enumerate(x)], "grp string, key string, features array<double>")


def test_scores_by_loops(spark):
    """Every score of every k; the gap as mean log dispersion of the references less that of the points."""
    rng = np.random.default_rng(6)
    sets = {"a": rng.normal(size=(30, 3)), "b": rng.normal(size=(9, 3)), "few": rng.normal(size=(4, 3))}
    got = {(r.grp, r.k): r for r in clustering.scores(vectors(spark, sets), "grp", "key", "features").collect()}
    assert {k for k in got} == {(g, k) for g in "ab" for k in linkage.candidates(len(sets[g]))}
    for (g, k), r in got.items():
        x = sets[g]
        n, d = x.shape
        labels = linkage.cut(linkage.average(x), k)
        lo, hi = x.min(axis=0), x.max(axis=0)
        logs = []
        for ref in range(10):
            y = np.array([[lo[j] + python_uniform((ref * n + i) * d + j + 1) * (hi[j] - lo[j]) for j in range(d)] for i in range(n)])
            logs.append(log_dispersion(y, linkage.cut(linkage.average(y), k)))
        assert r.gap == pytest.approx(np.mean(logs) - log_dispersion(x, labels))
        assert r.silhouette == pytest.approx(linkage.silhouette(linkage.distances(x), labels)) and r.inertia == pytest.approx(linkage.inertia(x, labels))
    draws = np.array([python_uniform(c) for c in range(1, 20_001)])
    assert abs(draws.mean() - 0.5) < 0.01 and abs(np.corrcoef(draws[1:], draws[:-1])[0, 1]) < 0.03 and np.histogram(draws, 10)[0].min() > 1800


def test_votes(spark):
    rows = [
        ("a", 3, 0.5, 10.0, 0.9, 100.0, 0.1), ("a", 4, 0.7, 9.0, 0.4, 40.0, 0.3), ("a", 5, 0.7, 8.0, 0.4, 35.0, 0.3),
        ("b", 3, None, None, None, 0.0, 0.1),
        ("c", 3, 0.1, 5.0, 0.5, 9.0, 0.0), ("c", 4, 0.2, 4.0, 0.6, 8.0, 0.1), ("c", 5, 0.1, 3.0, 0.7, 4.0, 0.2), ("c", 6, 0.1, 3.0, 0.7, 3.9, 0.1),
    ]
    df = spark.createDataFrame(rows, "grp string, k int, silhouette double, calinski_harabasz double, davies_bouldin double, inertia double, gap double")
    got = {}
    for r in clustering.votes(df).collect():
        got.setdefault(r.grp, {})[r.method] = r.k
    # Equal ones go to the smaller k; the elbow is the first drop below the mean one; ties go to the elbow, else to the smaller k.
    assert got["a"] == {"silhouette": 4, "calinski_harabasz": 3, "davies_bouldin": 4, "elbow": 5, "gap": 4, "chosen": 4}
    assert got["b"] == {"gap": 3, "chosen": 3}
    assert got["c"] == {"silhouette": 4, "calinski_harabasz": 3, "davies_bouldin": 3, "elbow": 4, "gap": 5, "chosen": 4}


@pytest.fixture()
def small_blocks(monkeypatch):
    def put(block, few, small=200_000):
        monkeypatch.setattr(forest, "BLOCK", block)
        monkeypatch.setattr(forest, "FEW", few)
        monkeypatch.setattr(forest, "SMALL", small)

    return put


@pytest.mark.parametrize("method, sizes", [("single", (33, 20)), ("average", (50, 80))])
def test_forest_has_the_merges_of_one_task(spark, small_blocks, method, sizes):
    """Two groups at once, one with equal points, under several sizes of blocks."""
    small_blocks(*sizes)
    rng = np.random.default_rng(len(method))
    sets = {"g": np.concatenate([rng.normal(size=(70, 3)), rng.normal(size=(50, 3)) + 6]), "h": rng.normal(size=(30, 3))}
    points = forest.with_ids(ranking.held(vectors(spark, sets)))
    edges = getattr(forest, method)(points)
    table = forest.merge_table(edges, points).toPandas()
    for g, x in sets.items():
        z, own = getattr(linkage, method)(x), table[table["grp"] == g].sort_values("step")
        assert (own[["a", "b", "size"]].to_numpy() == z[:, [0, 1, 3]]).all() and np.allclose(own["distance"], z[:, 2])
    for k in (5, 400):
        labels = forest.cut(edges, points, k).toPandas().sort_values(["grp", "key"])
        for g, x in sets.items():
            assert labels[labels["grp"] == g]["cluster"].tolist() == linkage.cut(getattr(linkage, method)(x), k).tolist()


def test_forest_of_equal_points(spark, small_blocks):
    small_blocks(16, 5)
    x = np.repeat([[0.0, 0.0], [3.0, 0.0], [0.0, 10.0]], [40, 3, 1], axis=0)
    points = forest.with_ids(ranking.held(vectors(spark, {"g": x})))
    for method in ("single", "average"):
        edges = ranking.held(getattr(forest, method)(points))
        assert edges.count() == 43 and sorted(round(r.d, 6) for r in edges.where("d > 0").collect()) == [3.0, round(getattr(linkage, method)(x)[-1, 2], 6)]
        for k in (2, 10):
            labels = forest.cut(edges, points, k).toPandas().sort_values("key")["cluster"].tolist()
            assert labels == linkage.cut(getattr(linkage, method)(x), k).tolist()


def test_components_in_rounds(spark, small_blocks):
    small_blocks(10, 5, 8)
    rng = np.random.default_rng(1)
    chain = [(i, i + 1) for i in range(40)]
    rest = [(100 + int(a), 100 + int(b)) for a, b in rng.integers(0, 60, (45, 2))]
    got = {r.id: r.root for r in forest.components(spark.createDataFrame(chain + rest, "a long, b long")).collect()}
    top = {i: i for e in chain + rest for i in e if e[0] != e[1]}
    for _ in top:
        for a, b in chain + rest:
            if a != b:
                top[a] = top[b] = min(top[a], top[b])
    assert got == top


def test_large_groups_like_small_ones(spark, small_blocks, monkeypatch):
    """What a task does with a group, rounds over blocks do with it too: clusters, scores, outliers, cuts at a distance."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(14, 2)) * 0.3 + c for c in ([0, 0], [9, 0], [0, 9], [9, 9])] + [np.array([[30.0, 30.0]])])
    df = vectors(spark, {"big": x, "little": x[:12]})
    monkeypatch.setattr(clustering, "REFERENCES", 2)

    def results():
        plain = lambda d: sorted(map(tuple, d.collect()))
        args = (df, "grp", "key", "features")
        return plain(clustering.assign(*args, k=4)), plain(clustering.outliers(*args, k=6)), plain(clustering.at_distance(*args, 2.0)), plain(clustering.merges(*args, "single").drop("distance")), plain(clustering.scores(*args))

    want = results()
    small_blocks(25, 45)
    monkeypatch.setattr(clustering, "LOCAL", 40)
    plain_candidates = linkage.candidates
    monkeypatch.setattr(linkage, "candidates", lambda n: plain_candidates(57 if n == 41 else n))
    got = results()
    assert got[:4] == want[:4]
    for a, b in zip(got[4], want[4], strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:])


def test_validity_of_parts(spark):
    rng = np.random.default_rng(10)
    rows, want = [], {}
    for part in ("p", "q"):
        x, labels = rng.normal(size=(25, 3)), rng.integers(0, 4, 25)
        rows += [(part, i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(labels, x))]
        want[part] = (linkage.silhouette(linkage.distances(x), labels), linkage.calinski_harabasz(x, labels), linkage.davies_bouldin(x, labels), linkage.inertia(x, labels), linkage.dispersion(x, labels))
    rows += [("one", 1, 1, [1.0, 2.0, 3.0]), ("one", 2, 1, [1.0, 2.0, 5.0])]
    got = {r.part: tuple(r)[2:] for r in composition.validity(spark.createDataFrame(rows, "part string, key int, cluster int, f array<double>"), "part", "key", "cluster", "f").collect()}
    for part, values in want.items():
        assert got[part] == pytest.approx(values)
    assert got["one"] == (None, None, None, pytest.approx(2.0), pytest.approx(1.0))


@pytest.mark.parametrize("own", [False, True])
def test_copies_of_blocks(spark, monkeypatch, own):
    """Of n members every one is in as many pairs of blocks as there are blocks in its part, or in its cluster."""
    monkeypatch.setattr(composition, "BLOCK", 16)
    monkeypatch.setattr(composition, "BLOCK_BYTES", 64 * 8 * 2)
    seen = spark.sparkContext.accumulator(0)
    plain = composition._products

    def counted(batches):
        def each():
            for b in batches:
                seen.add(sum(len(b.column(c)[i].values) for c in ("x", "y") for i in range(b.num_rows)))
                yield b

        return plain(each())

    monkeypatch.setattr(composition, "_products", counted)
    for n in (256, 1024):
        df = spark.range(n).select("id", (F.col("id") % 8).alias("c"), F.array(F.rand(1), F.rand(2)).alias("f"))
        before = seen.value
        assert composition.distance_sums(df, "id", "c", "f", own=own).where("ca = cb").count() == n
        copies = (seen.value - before) / n
        blocks = max(1, -(-(n // 8 if own else n) // 64)) if n > 64 else 1
        assert copies <= 3 * blocks + 5


def test_strict_profiles(spark):
    """Holes of any length are filled on the line; a key with a constant month, or with too few values, goes."""
    from loadloom.operators import comparison

    day = lambda m: datetime.date(2024, m, 1)
    rows = [("a", day(1), [0.0, None, 4.0, 8.0]), ("a", day(2), [2.0, None, None, 10.0]), ("flat", day(1), [1.0] * 4), ("flat", day(2), [1.0, 2.0, 3.0, 4.0]), ("few", day(1), [1.0, None, None, 2.0])]
    df = spark.createDataFrame(rows, "key string, date date, q array<double>")
    got = comparison.strict_profiles(df, "key", "date", "q", 4, 1).collect()
    assert {r.key for r in got} == {"a"}
    line = [0.0, 2.0, None, None, 4.0, None, 8.0, 10.0]  # slot by slot, month by month
    known = [i for i, v in enumerate(line) if v is not None]
    full = np.interp(range(8), known, [line[i] for i in known])
    for m in (1, 2):
        own = full[m - 1 :: 2]
        want = (own - own.min()) / (own.max() - own.min())
        assert [r.norm for r in sorted(got, key=lambda r: r.slot) if r.month == m] == pytest.approx(want.tolist())


def test_slot_means_of_few_values(spark):
    """Only slots with a value are rows to be shuffled; a vector without any still shows its key and month."""
    day = lambda m: datetime.date(2024, m, 1)
    rows = [("a", day(1), [None, 1.0, None]), ("a", day(1), [None, 3.0, 5.0]), ("a", day(2), [None] * 3), ("b", day(1), []), (None, day(1), [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "key string, date date, q array<double>")
    got = profiles.slot_means(df, "key", "date", "q", empty=False)
    assert sorted(map(tuple, got.where("slot is not null").collect())) == [("a", 1, 2, 2.0), ("a", 1, 3, 5.0)]
    assert sorted(map(tuple, got.where("slot is null").collect())) == [("a", 2, None, None)]
    every = profiles.slot_means(df, "key", "date", "q")
    assert every.count() == 6 and sorted(map(tuple, every.where("v is not null").collect())) == [("a", 1, 2, 2.0), ("a", 1, 3, 5.0)]


@pytest.mark.parametrize("least", [0, 0.5])
def test_strict_profiles_by_the_plain_rules(spark, least):
    """As a grid with windows has them, without a window over it."""
    from loadloom.operators import comparison

    rng = np.random.default_rng(12)
    rows = [(f"k{i}", datetime.date(2024, int(m), 1 + int(d)), [None if rng.random() < 0.4 + 0.1 * (i % 6) else round(float(rng.random()), 3) for _ in range(4)]) for i in range(30) for m, d in zip(rng.integers(1, 6, 8), range(8), strict=True)]
    rows += [("none", datetime.date(2024, 9, 1), [None] * 4), ("flat", datetime.date(2024, 1, 1), [1.0] * 4)]
    df = spark.createDataFrame(rows, "key string, date date, q array<double>")
    grid = profiles.complete_grid(profiles.slot_means(df, "key", "date", "q"), "key", "slot", 4)
    enough = grid.withColumn("ok", F.count("v").over(Window.partitionBy("key")) >= least * 4).where("ok").drop("ok")
    full = profiles.minmax(profiles.interpolate(enough, "key", "slot", limit=1 << 30), ["key", "month"])
    w = Window.partitionBy("key", "month")
    wide = full.withColumn("w", F.max("v").over(w) - F.min("v").over(w)).withColumn("f", F.min("w").over(Window.partitionBy("key"))).where("f > 0")
    want = {(r.key, r.month, r.slot): (r.v, r.norm) for r in wide.collect()}
    got = comparison.strict_profiles(df, "key", "date", "q", 4, least)
    assert "Window" not in got._jdf.queryExecution().toString()
    got = {(r.key, r.month, r.slot): (r.v, r.norm) for r in got.collect()}
    assert got.keys() == want.keys() and want and all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("j", [0, 1])
def test_products_hold_tiles(j):
    """Of two blocks no more than a few tiles of distances are in memory at once, and the sums are those of all pairs."""
    rng = np.random.default_rng(13)
    x, y = (rng.random((3000, 4)) for _ in "xy")
    y = y if j else x
    block = lambda v: [[{"key": i, "cluster": i % 3, "vector": r} for i, r in enumerate(v.tolist())]]
    kind = pa.list_(pa.struct([("key", pa.int64()), ("cluster", pa.int32()), ("vector", pa.list_(pa.float64()))]))
    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([0]), pa.array([j]), pa.array(block(x), kind), pa.array(block(y), kind)], ["part", "i", "j", "x", "y"])
    tracemalloc.start()
    got = pa.Table.from_batches(composition._products([batch])).to_pandas()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 5 * 8 * composition.TILE**2
    d = linkage.apart(x, y)
    want = [d[i, np.arange(3000) % 3 == c].sum() for i in range(3000) for c in range(3)]
    assert np.allclose(got["s"][:9000], want, atol=1e-5) and len(got) == (18000 if j else 9000)
