"""The report files of each analysis: workbooks and bundles of result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import taxonomy
from ..functions.binning import quality
from ..operators import comparison, composition, funnel
from . import store


def summary_workbook(meta: DataFrame, rows: DataFrame, group: str, key: str = "pod", ts: str = "ts", value: str = "value") -> bytes:
    """Key figures, all typologies, typologies of covered keys, and consumption by typology."""
    ok = funnel.covered(rows, key, ts)
    dim = meta.join(ok, key, "left_semi")
    monthly = funnel.monthly(rows.join(ok, key, "left_semi"), key, ts, value).join(meta.select(key, group), key)
    by = funnel.summary(monthly, [group], "total").withColumn("annual", F.bround(F.col("mean") * 12, 0))
    return store.workbook({"Numeri_Chiave": funnel.coverage(rows, key, ts), "Tipologie_Tutti_POD": funnel.census(meta, [group], key), "Tipologie_12mesi": funnel.census(dim, [group], key), "Riepilogo_per_Tipologia": by})


def _clustering_book(assigned: DataFrame, long: DataFrame, dim: DataFrame, code: str, key: str) -> dict[str, DataFrame]:
    """The fifteen sheets of one level's clusters."""
    named = assigned.join(dim, key, "left")
    numbers = [r[0] for r in assigned.select("cluster").distinct().orderBy("cluster").collect()]
    by = [c for c in ("l1", "l2") if c in dim.columns]
    vectors = long.groupBy("key", "cluster").agg(F.array_sort(F.collect_list(F.struct("slot", "v"))).alias("p"))
    vectors = vectors.select("key", "cluster", F.transform("p", lambda s: s["v"]).alias("vector"))
    pearson = composition.with_p(composition.centroid_pearson(long))
    stats = composition.stats(long).join(composition.mean_distances(vectors, "key", "cluster", "vector"), "cluster")
    return {
        "Cluster_Stats": stats,
        "Global_Metrics": composition.calinski_harabasz(long).join(F.broadcast(composition.davies_bouldin(long).drop("k"))).join(F.broadcast(composition.silhouette(vectors, "key", "cluster", "vector").drop("n"))),
        "Pearson_Corr": composition.square(pearson, "r", numbers, 1.0),
        "Pearson_PValues": composition.square(pearson, "p", numbers, 0.0),
        "POD_List": named,
        "Cluster_Composition": funnel.share(named, ["cluster", code], ["cluster"]),
        **{f"Composition_by_{c.upper()}": funnel.share(named, ["cluster", c], ["cluster"]) for c in by},
        "Profiles_with_Cluster": vectors.select("key", "cluster", F.concat_ws(";", F.transform("vector", lambda v: F.round(v, 6).cast("string"))).alias("profile")),
        "All_Centroids": composition.centroids(long),
        "ATECO_Dominant_Cluster": funnel.dominant(named, [code], "cluster"),
        "ATECO_Breakdown": composition.crosstab_text(named, code, "cluster", numbers),
        "Cluster_ATECO_Breakdown": composition.ranked(named, "cluster", code),
        **{f"Breakdown_by_{c.upper()}": composition.crosstab_text(named, c, "cluster", numbers) for c in by},
    }


def clustering_bundle(assigned: DataFrame, long: DataFrame, dim: DataFrame, code: str, key: str = "pod", issues: DataFrame | None = None, large: str | None = None) -> bytes:
    """The fifteen sheets of one level's clusters, the breakdown pages, the statistics page, and what went wrong on loading.

    ``assigned`` has the key and ``cluster``; ``long`` has ``key, cluster, slot, v``; ``dim`` the levels of each key.
    """
    book = _clustering_book(assigned, long, dim, code, key)
    texts = {"issues.txt": "\n".join(" ".join(map(str, r)) for r in store.small(issues)[1])} if issues is not None else None
    pages = {"ateco_breakdown": book["ATECO_Breakdown"], "cluster_breakdown": book["Cluster_ATECO_Breakdown"], "global_metrics": book["Global_Metrics"], "statistics": book["Cluster_Stats"]}
    return store.bundle({"clustering": book}, pages, texts, large)


def levels_bundle(levels: dict[str, tuple[DataFrame, DataFrame]], dim: DataFrame, monthly: DataFrame | None = None, key: str = "pod", issues: DataFrame | None = None, large: str | None = None) -> bytes:
    """Every level's clusters in one bundle: a workbook of fifteen sheets and the pages of each, and a workbook across them.

    ``levels`` has for the column of each level its ``assigned`` and ``long``. Across them: the correlation of the centroids of all levels as a matrix, each key with its cluster of
    every level, and, where ``monthly`` is given (``month, k``), the number of clusters of each month as one row.
    """
    books, pages, frames, member = {}, {}, {}, None
    for name, (assigned, long) in levels.items():
        book = books[f"clustering_{name.upper()}"] = _clustering_book(assigned, long, dim, name, key)
        pages |= {f"{name}_{page}": book[sheet] for page, sheet in (("ateco_breakdown", "ATECO_Breakdown"), ("cluster_breakdown", "Cluster_ATECO_Breakdown"), ("statistics", "Cluster_Stats"))}
        frames[name] = composition.centroids(long)
        own = assigned.select(key, F.col("cluster").alias(f"cluster_{name}"))
        member = own if member is None else member.join(own, key, "full")
    across = {"Clusters_by_Level": member}
    if len(frames) > 1:
        pairs = comparison.cross_level(frames)
        names = sorted({n for r in pairs.select("a", "b").distinct().collect() for n in r})  # of centroids
        across = {"Cross_Level_Pearson": composition.square(pairs, "r", names, 1.0)} | across
    if monthly is not None:
        across["K_per_Month"] = monthly.groupBy().pivot("month", list(range(1, 13))).agg(F.max("k"))
    texts = {"issues.txt": "\n".join(" ".join(map(str, r)) for r in store.small(issues)[1])} if issues is not None else None
    return store.bundle(books | {"across_levels": across}, pages, texts, large)


def comparison_bundle(metrics: DataFrame, profile: DataFrame, ranking: DataFrame | None = None, annual: DataFrame | None = None, large: str | None = None) -> bytes:
    """Metrics with grades, the profiles compared, and, where they are given, the ranking and the metrics of the year's points; a page for each."""
    graded = metrics.withColumn("quality", quality(F.col("rmse"))) if "rmse" in metrics.columns else metrics
    book = {"Monthly_Metrics": graded, "Profile_Data": profile}
    book |= {"Ranking": ranking} if ranking is not None else {}
    book |= {"Annual_Summary": annual} if annual is not None else {}
    return store.bundle({"comparison": book}, {"metrics": graded, "profiles": profile} | ({"ranking": ranking} if ranking is not None else {}), large=large)


def national_bundle(metrics: DataFrame, profile: DataFrame, group: str = "grp", large: str | None = None) -> bytes:
    """Metrics with grades and the profiles of the groups against the national reference: an overview page, and one for each group and month."""
    graded = metrics.withColumn("quality", quality(F.col("rmse")))
    names, rows = store.small(profile.orderBy(group, "month", "hour"))  # groups x 12 x 24 rows
    of, month = names.index(group), names.index("month")
    pages: dict[str, tuple] = {}
    for r in rows:
        pages.setdefault(f"{r[of]}_{r[month]:02d}", (names, []))[1].append(r)
    return store.bundle({"national": {"Metrics": graded, "Profiles": profile}}, {"overview": graded} | pages, large=large)


def descriptive_bundle(measures: DataFrame, assigned: DataFrame, long: DataFrame, large: str | None = None) -> bytes:
    """The older bundle: measures with their cluster, and summary, centroids, members and sizes of the clusters."""
    sizes = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    book = {"Summary": composition.stats(long), "Centroids": composition.centroids(long), "POD_Cluster_List": assigned, "Cluster_Sizes": sizes}
    return store.bundle({"measures_with_cluster": {"Measures": measures}, "descriptives": book}, large=large)


def provincial_bundle(energy: DataFrame, shape: DataFrame, own: DataFrame, large: str | None = None) -> bytes:
    """Energy and shape metrics against the provincial reference, and the profiles in kWh."""
    book = {"Metrics_Energy": energy, "Metrics_Shape": shape, "Profile_Data_kWh": own}
    return store.bundle({"provincial": book}, {"metrics": energy}, large=large)


def outlier_bundle(outliers: DataFrame, dim: DataFrame, code: str, key: str, gaps: DataFrame, titles: DataFrame | None = None, large: str | None = None) -> bytes:
    """Outliers with their dimension, their codes (with titles, where given), cluster sizes and data gaps with their severity."""
    named = outliers.join(dim, outliers["key"] == dim[key].cast("string"), "left")
    composed = funnel.share(named, [code], [])
    if titles is not None:
        composed = taxonomy.describe(composed, code, titles)
    gaps = gaps.withColumn("severe", F.col("missing_pct") > 20) if "missing_pct" in gaps.columns else gaps
    book = {"Outlier_PODs": named, "ATECO_Composition": composed, "Cluster_Sizes": outliers.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")), "Data_Gaps": gaps}
    return store.bundle({"outliers": book}, {"composition": composed}, large=large)
