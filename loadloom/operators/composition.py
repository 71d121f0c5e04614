"""What clusters are made of: centroids, validity, composition, correlation.

All in DataFrame operations over long form (``key``, ``cluster``, ``slot``, ``v``); pairs are of centroids or of members of one fixed-size
sample-free table, joined on slots.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import count_and_percent
from .compare import pearson
from .linkage import apart


def long_form(df: DataFrame, key: str, cluster: str, vector: str) -> DataFrame:
    got = df.select(F.col(key).alias("key"), F.col(cluster).alias("cluster"), F.posexplode(vector).alias("slot", "v"))
    return got.withColumn("v", F.col("v").cast("double"))


def centroids(long: DataFrame) -> DataFrame:
    return long.groupBy("cluster", "slot").agg(F.avg("v").alias("v"))


def centroid_pearson(long: DataFrame) -> DataFrame:
    """Correlation of each pair of centroids, joined on slots."""
    c = centroids(long)
    a, b = c.select(F.col("cluster").alias("a"), "slot", F.col("v").alias("va")), c.select(F.col("cluster").alias("b"), "slot", F.col("v").alias("vb"))
    return a.join(b, "slot").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), pearson(F.col("va"), F.col("vb")).alias("r"))


def pearson_p(r: float, n: int) -> float | None:
    """Two-sided p-value of a correlation: the regularised incomplete beta function of (n - 2) / 2 and 1/2 at 1 - r²."""
    if r is None or n < 3:
        return None
    return incomplete_beta((n - 2) / 2, 0.5, max(0.0, min(1.0, 1 - r * r)))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """By Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(300):
        m = i // 2
        if i == 0:
            step = 1.0
        elif i % 2 == 0:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (max(abs(1 + step * d), 1e-300) * np.sign(1 + step * d or 1))
        c = 1 + step / (c or 1e-300)
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return float(front * (f - 1))


def with_p(pairs: DataFrame) -> DataFrame:
    """Pairs of clusters with ``r`` and ``n``, and the p-value of each."""
    schema = T.StructType([*pairs.schema.fields, T.StructField("p", T.DoubleType())])

    def run(batches):
        for batch in batches:
            r, n = (batch.column(c).to_pylist() for c in ("r", "n"))
            p = pa.array([pearson_p(*x) for x in zip(r, n, strict=True)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, p], [*batch.schema.names, "p"])

    return pairs.mapInArrow(run, schema)


def square(pairs: DataFrame, value: str, names: list, diagonal: float, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs as a matrix: a row and a column for each of ``names``, mirrored, with ``diagonal`` where a name meets itself."""
    both = pairs.select(F.col(a).alias("name"), F.col(b).alias("other"), F.col(value).alias("v"))
    mirrored = both.unionByName(pairs.select(F.col(b).alias("name"), F.col(a).alias("other"), F.col(value).alias("v")))
    own = mirrored.select("name").distinct().select("name", F.col("name").alias("other"), F.lit(float(diagonal)).alias("v"))
    return mirrored.unionByName(own).groupBy("name").pivot("other", names).agg(F.max("v")).orderBy("name")


def inertia(long: DataFrame) -> DataFrame:
    """Sum of squared distances to the own centroid, by cluster."""
    w = Window.partitionBy("cluster", "slot")
    return long.withColumn("d", F.pow(F.col("v") - F.avg("v").over(w), 2)).groupBy("cluster").agg(F.sum("d").alias("within"), F.countDistinct("key").alias("size"))


def calinski_harabasz(long: DataFrame) -> DataFrame:
    """Dispersion between over within clusters, each by its degrees of freedom."""
    c = centroids(long)
    overall = long.groupBy("slot").agg(F.avg("v").alias("g"))
    sizes = long.groupBy("cluster").agg(F.countDistinct("key").alias("size"))
    between = c.join(overall, "slot").join(sizes, "cluster").agg(F.sum(F.col("size") * F.pow(F.col("v") - F.col("g"), 2)).alias("between"))
    within = inertia(long).agg(F.sum("within").alias("within"), F.sum("size").alias("n"), F.count(F.lit(1)).alias("k"))
    got = between.join(F.broadcast(within))
    ratio = F.try_divide(F.col("between") * (F.col("n") - F.col("k")), F.col("within") * (F.col("k") - 1))
    return got.select("k", "n", ratio.alias("calinski_harabasz"))


def davies_bouldin(long: DataFrame) -> DataFrame:
    """Mean over clusters of the worst ratio of spreads to the distance of centroids."""
    c = centroids(long)
    spread = long.join(c.withColumnRenamed("v", "c"), ["cluster", "slot"]).groupBy("cluster", "key").agg(F.sqrt(F.sum(F.pow(F.col("v") - F.col("c"), 2))).alias("d"))
    spread = spread.groupBy("cluster").agg(F.avg("d").alias("s"))
    a = c.select(F.col("cluster").alias("a"), "slot", F.col("v").alias("va"))
    b = c.select(F.col("cluster").alias("b"), "slot", F.col("v").alias("vb"))
    apart = a.join(b, "slot").where("a <> b").groupBy("a", "b").agg(F.sqrt(F.sum(F.pow(F.col("va") - F.col("vb"), 2))).alias("m"))
    side = lambda x: spread.select(F.col("cluster").alias(x), F.col("s").alias(f"s{x}"))
    ratios = apart.join(side("a"), "a").join(side("b"), "b").withColumn("r", F.try_divide(F.col("sa") + F.col("sb"), F.col("m")))
    return ratios.groupBy("a").agg(F.max("r").alias("r")).agg(F.count(F.lit(1)).alias("k"), F.avg("r").alias("davies_bouldin"))


#: Least members of a block and most bytes of its vectors; the distances of TILE members to as many are one matrix product.
BLOCK, BLOCK_BYTES, TILE = 1024, 4_000_000, 1024
#: Most tasks of a product.
MOST_TASKS = 8192


def _products(batches):
    """Pairs of blocks -> for each member the sum of its distances to the other block's members, by their cluster."""
    for batch in batches:
        for row in range(batch.num_rows):
            one = batch.column("i")[row] == batch.column("j")[row]
            x, y = (batch.column(c)[row].values for c in ("x", "x" if one else "y"))
            m, o = (np.asarray(s.field("vector").flatten().to_numpy(zero_copy_only=False), float).reshape(len(s), -1) for s in (x, y))
            codes = [s.field("cluster").dictionary_encode() for s in (x, y)]
            hot = [np.eye(len(c.dictionary))[c.indices.to_numpy()] for c in codes]
            sums = [np.zeros((len(x), hot[1].shape[1])), np.zeros((len(y), hot[0].shape[1]))]
            for i in range(0, len(m), TILE):
                for j in range(i if one else 0, len(o), TILE):
                    d = apart(m[i : i + TILE], o[j : j + TILE])
                    if one and i == j:
                        np.fill_diagonal(d, 0.0)
                    sums[0][i : i + TILE] += d @ hot[1][j : j + TILE]
                    if not one or i < j:
                        sums[not one][j : j + TILE] += d.T @ hot[0][i : i + TILE]
            for own, total, other in [(x, sums[0], 1), (y, sums[1], 0)][: 1 if one else 2]:
                n, k = total.shape
                at = pa.array(np.repeat(np.arange(n), k))
                count = np.tile(hot[other].sum(axis=0).astype(np.int64), n)
                part = pa.array([batch.column("part")[row].as_py()] * (n * k), batch.schema.field("part").type)
                yield pa.RecordBatch.from_arrays([part, own.field("key").take(at), own.field("cluster").take(at), codes[other].dictionary.take(pa.array(np.tile(np.arange(k), n))), pa.array(total.ravel()), pa.array(count)], ["part", "ka", "ca", "cb", "s", "n"])


def distance_sums(df: DataFrame, key: str, cluster: str, vector: str, part: str | None = None, own: bool = False) -> DataFrame:
    """``part, ka, ca, cb, s, n``: each member's Euclidean distances to the members of each cluster of its part, their sum and number (itself included, at 0).

    Members are dealt into blocks within their part; a pair of blocks is a few matrix products, and its sums by cluster are added up. With ``own`` only the own cluster is asked for, and blocks are dealt
    within it, so that no other pair is looked at. A block holds as many members as leave a few pairs to each core, BLOCK_BYTES of vectors at most: it is sent to every
    other block of its part, and the larger blocks are, the fewer these are.
    """
    rows = df.select((F.col(part) if part else F.lit(0)).alias("part"), F.col(key).alias("key"), F.col(cluster).alias("cluster"), F.col(vector).cast("array<double>").alias("vector")).where("vector is not null and cluster is not null")
    dealt = ["part", "cluster"] if own else ["part"]
    sizes = rows.groupBy(*dealt).agg(F.count(F.lit(1)).alias("members"), F.max(F.size("vector")).alias("width"))
    most = sizes.agg(F.max("members").alias("members"), F.max("width").alias("width")).first()
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = max(BLOCK, min(BLOCK_BYTES // (8 * max(1, most["width"] or 1)), round((most["members"] or 1) / (2 * cores) ** 0.5)))
    blocks = sizes.select(*[F.col(c).alias(f"__{c}") for c in dealt], F.ceil(F.col("members") / size).cast("int").alias("blocks"))
    number = blocks.agg(F.sum(F.expr("cast(blocks as long) * (blocks + 1) div 2"))).first()[0] or 1
    same = rows["part"].eqNullSafe(F.col("__part"))
    tagged = rows.join(blocks, same & rows["cluster"].eqNullSafe(F.col("__cluster")) if own else same)
    named = [*dealt, F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("i")]
    packed = tagged.groupBy(*named).agg(F.max("blocks").alias("blocks"), F.collect_list(F.struct("key", "cluster", "vector")).alias("x"))
    left = packed.withColumn("j", F.explode(F.sequence(F.col("i"), F.col("blocks") - 1))).drop("blocks")
    right = packed.select(*[F.col(c).alias(f"__{c}") for c in dealt], F.col("i").alias("__j"), F.col("x").alias("y"))
    match = (F.col("j") == F.col("__j")) & F.col("part").eqNullSafe(F.col("__part"))
    pairs = left.join(right, match & F.col("cluster").eqNullSafe(F.col("__cluster")) if own else match)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    sums = pairs.select("part", "i", "j", "x", "y", *(["cluster"] if own else [])).repartition(max(1, min(MOST_TASKS, number)), *dealt, "i", "j").select("part", "i", "j", "x", "y")
    sums = sums.mapInArrow(_products, f"part {kinds['part']}, ka {kinds['key']}, ca {kinds['cluster']}, cb {kinds['cluster']}, s double, n long")
    return sums.groupBy("part", "ka", "ca", "cb").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def silhouettes(sums: DataFrame) -> DataFrame:
    """``part, n, silhouette``: the mean silhouette of each part, from :func:`distance_sums`."""
    own = F.max(F.when(F.col("ca") == F.col("cb"), F.try_divide(F.col("s"), F.col("n") - 1)))
    size = F.max(F.when(F.col("ca") == F.col("cb"), F.col("n")))
    near = F.min(F.when(F.col("ca") != F.col("cb"), F.col("s") / F.col("n")))
    each = sums.groupBy("part", "ka").agg(own.alias("a"), near.alias("b"), size.alias("size"))
    s = F.when(F.col("size") == 1, 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return each.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.avg(s).alias("silhouette"))


def silhouette(df: DataFrame, key: str, cluster: str, vector: str) -> DataFrame:
    """Mean silhouette with Euclidean distances, over the sums of :func:`distance_sums`; a row even of nothing."""
    got = silhouettes(distance_sums(df, key, cluster, vector))
    return got.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.max("silhouette").alias("silhouette"))


def mean_distances(df: DataFrame, key: str, cluster: str, vector: str) -> DataFrame:
    """By cluster the mean distance of two of its members; 0 where it has one."""
    own = distance_sums(df, key, cluster, vector, own=True).groupBy(F.col("ca").alias("cluster")).agg(F.sum("s").alias("s"), F.max("n").alias("n"))
    return own.select("cluster", F.coalesce(F.try_divide(F.col("s"), F.col("n") * (F.col("n") - 1)), F.lit(0.0)).alias("mean_distance"))


def validity(df: DataFrame, part: str, key: str, cluster: str, vector: str) -> DataFrame:
    """``part, clusters, silhouette, calinski_harabasz, davies_bouldin, inertia, dispersion`` of every part's clustering; the first three are null unless there are at least two clusters and fewer than members."""
    rows = df.select(F.col(part).alias("part"), F.col(key).alias("key"), F.col(cluster).alias("cluster"), F.col(vector).cast("array<double>").alias("vector"))
    sums = distance_sums(rows, "key", "cluster", "vector", "part")
    own = sums.where("ca = cb").groupBy("part", "ca").agg((F.sum("s") / 2 / F.max("n")).alias("w")).groupBy("part").agg(F.sum("w").alias("dispersion"))
    long = rows.select("part", "key", "cluster", F.posexplode("vector").alias("slot", "v"))
    means = long.groupBy("part", "cluster", "slot").agg(F.avg("v").alias("c"), F.count(F.lit(1)).alias("size"))
    overall = long.groupBy("part", "slot").agg(F.avg("v").alias("g"))
    squares = long.join(means, ["part", "cluster", "slot"]).groupBy("part", "cluster", "key").agg(F.sum(F.pow(F.col("v") - F.col("c"), 2)).alias("sq"))
    within = squares.groupBy("part", "cluster").agg(F.sum("sq").alias("sq"), F.avg(F.sqrt("sq")).alias("spread"), F.count(F.lit(1)).alias("size"))
    between = means.join(overall, ["part", "slot"]).groupBy("part").agg(F.sum(F.col("size") * F.pow(F.col("c") - F.col("g"), 2)).alias("between"))
    total = within.groupBy("part").agg(F.sum("sq").alias("inertia"), F.sum("size").alias("members"), F.count(F.lit(1)).alias("clusters"))
    side = lambda x: means.select("part", "slot", F.col("cluster").alias(x), F.col("c").alias(f"v{x}"))
    apart_ = side("a").join(side("b"), ["part", "slot"]).where("a <> b").groupBy("part", "a", "b").agg(F.sqrt(F.sum(F.pow(F.col("va") - F.col("vb"), 2))).alias("m"))
    spread = lambda x: within.select("part", F.col("cluster").alias(x), F.col("spread").alias(f"s{x}"))
    worst = apart_.join(spread("a"), ["part", "a"]).join(spread("b"), ["part", "b"]).groupBy("part", "a").agg(F.max(F.try_divide(F.col("sa") + F.col("sb"), F.col("m"))).alias("r"))
    db = worst.groupBy("part").agg(F.avg(F.coalesce("r", F.lit(0.0))).alias("davies_bouldin"))
    ok = (F.col("clusters") >= 2) & (F.col("clusters") < F.col("members"))
    ch = F.coalesce(F.try_divide(F.col("between") * (F.col("members") - F.col("clusters")), F.col("inertia") * (F.col("clusters") - 1)), F.lit(1.0))
    got = total.join(between, "part").join(silhouettes(sums).drop("n"), "part").join(own, "part").join(db, "part", "left")
    return got.select("part", "clusters", *[F.when(ok, c).alias(n) for n, c in (("silhouette", F.col("silhouette")), ("calinski_harabasz", ch), ("davies_bouldin", F.col("davies_bouldin")))], "inertia", "dispersion")


def stats(long: DataFrame) -> DataFrame:
    """Size, share, slots of the peak and of the trough, greatest, least and mean value of each centroid, and the mean over slots of the standard deviation."""
    c = centroids(long)
    sizes = long.groupBy("cluster").agg(F.countDistinct("key").alias("size"))
    sizes = sizes.withColumn("pct", F.round(100.0 * F.col("size") / F.sum("size").over(Window.partitionBy()), 2))
    peak = F.max(F.struct("v", (-F.col("slot")).alias("s")))
    low = F.min(F.struct("v", F.col("slot").alias("s")))
    got = c.groupBy("cluster").agg(peak.alias("p"), low.alias("t"), F.avg("v").alias("mean"))
    got = got.select("cluster", (-F.col("p.s")).alias("peak_slot"), F.col("t.s").alias("trough_slot"), F.col("p.v").alias("max"), F.col("t.v").alias("min"), "mean")
    spread = long.groupBy("cluster", "slot").agg(F.stddev_samp("v").alias("sd")).groupBy("cluster").agg(F.avg("sd").alias("mean_std"))
    return sizes.join(got, "cluster").join(spread, "cluster")


def crosstab_text(df: DataFrame, row: str, column: str, columns: list) -> DataFrame:
    """Cells ``n (p%)`` by row and column, — where there is nothing."""
    n = df.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("cell", count_and_percent(F.col("n"), F.sum("n").over(Window.partitionBy(row))))
    return n.groupBy(row).pivot(column, columns).agg(F.first("cell")).na.fill("—")


def ranked(df: DataFrame, by: str, category: str) -> DataFrame:
    """The categories of each group from the most frequent on."""
    n = df.groupBy(by, category).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(by).orderBy(F.col("n").desc(), category)
    return n.withColumns({"rank": F.row_number().over(w), "pct": F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(by)), 2)})


def elbow(table: DataFrame, k: str = "k", value: str = "inertia") -> DataFrame:
    """The first k whose relative drop is below the mean drop, else the first that has a drop; needs three values. The table has a row for each k."""
    w = Window.orderBy(k)
    before = F.lag(value).over(w)
    drops = table.withColumn("drop", F.when(before > 0, (before - F.col(value)) / before))
    drops = drops.withColumn("mean", F.avg("drop").over(Window.partitionBy()))
    hit, first = F.min(F.when(F.col("drop") < F.col("mean"), F.col(k))), F.min(F.when(F.col("drop").isNotNull(), F.col(k)))
    n = drops.agg(F.count(F.lit(1)).alias("n"), first.alias("first"), hit.alias("hit"))
    return n.select(F.when(F.col("n") >= 3, F.coalesce("hit", "first")).alias("elbow_k"))


def legend(df: DataFrame, key: str, level_columns: list[str]) -> DataFrame:
    """Every code of every level with its distinct keys."""
    levels = F.array(*[F.struct(F.lit(i).alias("level"), F.col(c).alias("code")) for i, c in enumerate(level_columns, 1)])
    long = df.select(key, F.explode(levels).alias("x")).select(key, "x.level", "x.code").where("code is not null")
    return long.groupBy("level", "code").agg(F.countDistinct(key).alias("n"))
