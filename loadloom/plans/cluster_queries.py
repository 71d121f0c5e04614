"""Queries of clusters: given labels by SQL, found ones by grouped tasks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import clustering, composition, funnel, profiles
from .frames import PLACES, READINGS, VECTORS, places, readings, vectors
from .registry import register

CENTROIDS = f"(SELECT cluster, CAST(slot AS INT) AS slot, avg(v) AS v FROM {VECTORS} GROUP BY ALL)"


def _long(spark, sf):
    return composition.long_form(vectors(spark, sf), "key", "cluster", "features")


def _by_user(spark, sf):
    """Readings dealt by user, once for all the groupings after: there is hardly more than one to an hour of a month, so sums of hours would be as many rows in a shuffle of each grouping."""
    return readings(spark, sf).select("key", "ts", "value").repartition("key")


def _profiles(spark, sf):
    """Users' profiles of a day as vectors, in five groups of users."""
    h = profiles.overall(profiles.hourly(_by_user(spark, sf), "key", "ts", "value"), "key")
    grid = h.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("hour", "v"))).alias("m"))
    q = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)))
    return grid.select("key", (F.col("key") % 5).alias("grp"), q.alias("features"))


#: The same in SQL, and the distances of the members of each group. Members are numbered by their key as text.
MEMBERS = f"""p AS MATERIALIZED (SELECT key, key % 5 AS grp, list(v ORDER BY hour) AS q, row_number() OVER (PARTITION BY key % 5 ORDER BY CAST(key AS VARCHAR)) AS i FROM (SELECT k.key, h.hour, coalesce(avg(v), 0) AS v
FROM (SELECT DISTINCT key FROM {READINGS}) k CROSS JOIN (SELECT range AS hour FROM range(24)) h LEFT JOIN (SELECT key, month(ts) AS month, hour(ts) AS hour, avg(value) AS v FROM {READINGS} GROUP BY ALL) r ON r.key = k.key AND r.hour = h.hour GROUP BY ALL) GROUP BY key)"""
POINTS = f"{MEMBERS}, d AS MATERIALIZED (SELECT a.grp, a.i, b.i AS j, list_distance(a.q, b.q) AS d FROM p a JOIN p b ON a.grp = b.grp)"
#: Average linkage, a merge a step: by member the label and the number of its cluster, and the merge that was made.
AVERAGE = f"""{POINTS}, c(grp, step, labels, ids, a, b, height) AS (SELECT grp, 0, list(i ORDER BY i), list(i - 1 ORDER BY i), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS DOUBLE) FROM p GROUP BY grp
UNION ALL SELECT c.grp, step + 1, list_transform(labels, lambda x: CASE WHEN x = m.b THEN m.a ELSE x END), list_transform(ids, lambda x, k: CASE WHEN labels[k] = m.a OR labels[k] = m.b THEN len(labels) + step ELSE x END), ids[m.a], ids[m.b], m.h
FROM c, LATERAL (SELECT a, b, h FROM (SELECT c.labels[d.i] AS a, c.labels[d.j] AS b, avg(d.d) AS h FROM d WHERE d.grp = c.grp AND c.labels[d.i] < c.labels[d.j] GROUP BY ALL) ORDER BY h, a, b LIMIT 1) m)"""
#: Single linkage: of each pair the largest step on the best way between them, for up to 2^8 members; the heights of the merges are those of the pairs without a better way.
NEAREST = "".join(f", m{n} AS MATERIALIZED (SELECT a.grp, a.i, b.j, min(greatest(a.d, b.d)) AS d FROM {'d' if n == 1 else f'm{n - 1}'} a JOIN {'d' if n == 1 else f'm{n - 1}'} b ON a.grp = b.grp AND a.j = b.i GROUP BY ALL)" for n in range(1, 9))
OUTLIERS = f"""{POINTS}{NEAREST}, h AS (SELECT d.grp, d.d, row_number() OVER (PARTITION BY d.grp ORDER BY d.d) AS k FROM d JOIN m8 USING (grp, i, j) WHERE i < j AND d.d = m8.d), n AS (SELECT grp, count(*) AS n FROM p GROUP BY grp HAVING count(*) >= 10),
t AS (SELECT n.grp, coalesce(max(h.d) FILTER (k = n - 20), -1) AS t FROM n LEFT JOIN h USING (grp) GROUP BY n.grp), f AS (SELECT CAST(m8.grp AS VARCHAR) AS grp, CAST(p.key AS VARCHAR) AS key, min(CAST(o.key AS VARCHAR)) AS cluster, count(*) AS size FROM m8 JOIN t USING (grp) JOIN p ON p.grp = m8.grp AND p.i = m8.i JOIN p o ON o.grp = m8.grp AND o.i = m8.j WHERE m8.d <= t OR m8.i = m8.j GROUP BY m8.grp, p.key HAVING count(*) < 5)"""


#: Number j of a counter-based generator, as in :func:`..operators.clustering.uniform`.
UNIFORM = "((x3 * x3 + x2) % 2147483647) / CAST(2147483647 AS DOUBLE)"


def _votes_sql(points: str) -> str:
    """Scores by group and k in SQL, for ``points`` (grp, i, q), numbered within the group: every set of points, its merges, its cuts and what they are worth."""
    return f"""g AS MATERIALIZED (SELECT grp, i, q FROM {points}), n AS MATERIALIZED (SELECT grp, count(*) AS n, greatest(3, least(10, CAST(floor(sqrt(count(*))) AS BIGINT))) AS most FROM g GROUP BY grp HAVING count(*) >= 5),
v AS (SELECT grp, i, unnest(range(len(q))) AS j, unnest(q) AS v FROM g), b AS MATERIALIZED (SELECT grp, j, min(v) AS lo, max(v) AS hi, count(*) OVER (PARTITION BY grp) AS w FROM v GROUP BY grp, j),
u AS (SELECT g.grp, r.range AS ref, i, j, lo, hi, (r.range * n + i - 1) * w + j + 1 AS c FROM g JOIN n USING (grp) JOIN b USING (grp) CROSS JOIN range(10) r), u1 AS (SELECT *, (c * 48271 + 12345) % 2147483647 AS x1 FROM u),
u2 AS (SELECT *, (x1 * x1 + c) % 2147483647 AS x2 FROM u1), u3 AS (SELECT *, (x2 * 69621 + x1) % 2147483647 AS x3 FROM u2),
s AS MATERIALIZED (SELECT grp, -1 AS ref, i, q FROM g JOIN n USING (grp) UNION ALL SELECT grp, ref, i, list(lo + {UNIFORM} * (hi - lo) ORDER BY j) FROM u3 GROUP BY grp, ref, i),
d AS MATERIALIZED (SELECT a.grp, a.ref, a.i, b.i AS j, list_distance(a.q, b.q) AS d FROM s a JOIN s b ON a.grp = b.grp AND a.ref = b.ref),
c(grp, ref, step, labels) AS (SELECT grp, ref, 0, list(i ORDER BY i) FROM s GROUP BY grp, ref UNION ALL SELECT c.grp, c.ref, step + 1, list_transform(labels, lambda x: CASE WHEN x = m.b THEN m.a ELSE x END)
FROM c, LATERAL (SELECT a, b FROM (SELECT c.labels[d.i] AS a, c.labels[d.j] AS b, avg(d.d) AS h FROM d WHERE d.grp = c.grp AND d.ref = c.ref AND c.labels[d.i] < c.labels[d.j] GROUP BY ALL) ORDER BY h, a, b LIMIT 1) m WHERE step < len(labels) - 3),
l AS MATERIALIZED (SELECT c.grp, ref, n - step AS k, unnest(range(1, n + 1)) AS i, unnest(labels) AS c FROM c JOIN n ON n.grp = c.grp AND n - step BETWEEN 3 AND most),
t AS (SELECT l.grp, l.ref, l.k, l.i, l.c, o.c AS o, sum(d) AS s, count(*) AS m FROM l JOIN l o ON o.grp = l.grp AND o.ref = l.ref AND o.k = l.k JOIN d ON d.grp = l.grp AND d.ref = l.ref AND d.i = l.i AND d.j = o.i WHERE l.ref = -1 OR l.c = o.c GROUP BY ALL),
w AS (SELECT grp, ref, k, ln(greatest(sum(s / 2 / m), 1e-300)) AS w FROM t WHERE c = o GROUP BY ALL), gap AS (SELECT grp, k, avg(w) FILTER (ref >= 0) - max(w) FILTER (ref = -1) AS gap FROM w GROUP BY ALL),
e AS (SELECT grp, k, i, max(m) FILTER (c = o) AS size, max(s / nullif(m - 1, 0)) FILTER (c = o) AS a, min(s / m) FILTER (c <> o) AS b FROM t WHERE ref = -1 GROUP BY ALL),
sil AS (SELECT grp, k, CASE WHEN k < count(*) THEN avg(CASE WHEN size = 1 THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END) END AS silhouette FROM e GROUP BY grp, k),
z AS MATERIALIZED (SELECT l.grp, k, c, l.i, j, v, avg(v) OVER (PARTITION BY l.grp, k, c, j) AS mean, avg(v) OVER (PARTITION BY l.grp, k, j) AS whole FROM l JOIN v ON v.grp = l.grp AND v.i = l.i WHERE ref = -1),
i AS (SELECT grp, k, sum(pow(v - mean, 2)) AS inertia, sum(pow(mean - whole, 2)) AS between, count(DISTINCT i) AS n FROM z GROUP BY ALL),
sp AS (SELECT grp, k, c, avg(r) AS r FROM (SELECT grp, k, c, i, sqrt(sum(pow(v - mean, 2))) AS r FROM z GROUP BY ALL) GROUP BY ALL), mean AS (SELECT DISTINCT grp, k, c, j, mean FROM z),
ap AS (SELECT a.grp, a.k, a.c, b.c AS o, sqrt(sum(pow(a.mean - b.mean, 2))) AS m FROM mean a JOIN mean b ON a.grp = b.grp AND a.k = b.k AND a.j = b.j AND a.c <> b.c GROUP BY ALL),
db AS (SELECT grp, k, avg(r) AS davies_bouldin FROM (SELECT ap.grp, ap.k, ap.c, max((x.r + y.r) / nullif(m, 0)) AS r FROM ap JOIN sp x ON x.grp = ap.grp AND x.k = ap.k AND x.c = ap.c JOIN sp y ON y.grp = ap.grp AND y.k = ap.k AND y.c = ap.o GROUP BY ALL) GROUP BY ALL),
f AS MATERIALIZED (SELECT grp, k, silhouette, CASE WHEN k < n THEN coalesce(between * (n - k) / nullif(inertia * (k - 1), 0), 1) END AS ch, CASE WHEN k < n THEN davies_bouldin END AS db, inertia, gap FROM i JOIN sil USING (grp, k) JOIN gap USING (grp, k) LEFT JOIN db USING (grp, k)),
dr AS (SELECT *, CASE WHEN lag(inertia) OVER w > 0 THEN (lag(inertia) OVER w - inertia) / lag(inertia) OVER w END AS drop FROM f WINDOW w AS (PARTITION BY grp ORDER BY k)), dm AS (SELECT *, avg(drop) OVER (PARTITION BY grp) AS m FROM dr),
vote AS MATERIALIZED (SELECT grp, 'silhouette' AS method, first(k ORDER BY silhouette DESC, k) AS k FROM f WHERE silhouette IS NOT NULL GROUP BY grp UNION ALL SELECT grp, 'calinski_harabasz', first(k ORDER BY ch DESC, k) FROM f WHERE ch IS NOT NULL GROUP BY grp
UNION ALL SELECT grp, 'davies_bouldin', first(k ORDER BY db, k) FROM f WHERE db IS NOT NULL GROUP BY grp UNION ALL SELECT grp, 'gap', first(k ORDER BY gap DESC, k) FROM f GROUP BY grp
UNION ALL SELECT grp, 'elbow', e FROM (SELECT grp, coalesce(min(k) FILTER (drop < m), min(k) FILTER (drop IS NOT NULL)) AS e FROM dm GROUP BY grp HAVING count(*) >= 3) WHERE e IS NOT NULL),
chosen AS MATERIALIZED (SELECT grp, first(k ORDER BY n DESC, k <> e, k) AS k FROM (SELECT grp, k, count(*) AS n, coalesce((SELECT o.k FROM vote o WHERE o.grp = vote.grp AND o.method = 'elbow'), -1) AS e FROM vote GROUP BY grp, k) GROUP BY grp)"""


#: Users by month, their hours as vectors.
BY_MONTH = f"""(SELECT grp, key, q, row_number() OVER (PARTITION BY grp ORDER BY CAST(key AS VARCHAR)) AS i FROM (SELECT k.grp, k.key, list(coalesce(r.v, 0) ORDER BY h.range) AS q FROM (SELECT DISTINCT key, month(ts) AS grp FROM {READINGS}) k CROSS JOIN range(24) h
LEFT JOIN (SELECT key, month(ts) AS grp, hour(ts) AS hour, avg(value) AS v FROM {READINGS} GROUP BY ALL) r ON r.key = k.key AND r.grp = k.grp AND r.hour = h.range GROUP BY ALL))"""
SETS = f"WITH RECURSIVE {MEMBERS}, {_votes_sql('p')}"
MONTHS = f"WITH RECURSIVE p AS MATERIALIZED {BY_MONTH}, {_votes_sql('p')}"


def _by_least_key(df):
    """Clusters by the least key of their members in place of a number."""
    return df.withColumn("cluster", F.min("key").over(Window.partitionBy("grp", "cluster")))


@register("centroids", f"SELECT cluster, slot, round(v, 5) AS v FROM {CENTROIDS}")
def centroids(spark, sf):
    return composition.centroids(_long(spark, sf)).withColumn("v", F.round("v", 5))


@register("centroid_pearson", f"SELECT a.cluster AS a, b.cluster AS b, count(*) AS n, round(covar_pop(a.v, b.v) / nullif(stddev_pop(a.v) * stddev_pop(b.v), 0), 5) AS r FROM {CENTROIDS} a JOIN {CENTROIDS} b USING (slot) WHERE a.cluster < b.cluster GROUP BY ALL")
def centroid_pearson(spark, sf):
    return composition.centroid_pearson(_long(spark, sf)).withColumn("r", F.round("r", 5))


@register("centroid_pearson_p", f"""WITH r AS (SELECT a.cluster AS a, b.cluster AS b, count(*) AS n, covar_pop(a.v, b.v) / nullif(stddev_pop(a.v) * stddev_pop(b.v), 0) AS r FROM {CENTROIDS} a JOIN {CENTROIDS} b USING (slot) WHERE a.cluster < b.cluster GROUP BY ALL)
SELECT a, b, n, round(r, 6) AS r, round(1 - abs(r) * (SELECT sum(exp(lgamma(2 * j + 1) - 2 * lgamma(j + 1) - j * ln(4)) * pow(1 - r * r, j)) FROM range(CAST((n - 2) / 2 AS BIGINT)) t(j)), 6) AS p FROM r""")
def centroid_pearson_p(spark, sf):
    """Correlations of centroids with their p-values: as many rows as pairs of clusters."""
    got = composition.with_p(composition.centroid_pearson(_long(spark, sf)))
    return got.withColumns({c: F.round(c, 6) for c in ("r", "p")})


@register("inertia", f"SELECT cluster, round(sum(pow(x.v - c.v, 2)), 3) AS within, count(DISTINCT key) AS size FROM {VECTORS} x JOIN {CENTROIDS} c USING (cluster, slot) GROUP BY cluster")
def inertia(spark, sf):
    return composition.inertia(_long(spark, sf)).withColumn("within", F.round("within", 3))


@register("calinski_harabasz", f"""WITH g AS (SELECT slot, avg(v) AS g FROM {VECTORS} GROUP BY slot), s AS (SELECT cluster, count(DISTINCT key) AS size FROM {VECTORS} GROUP BY cluster), b AS (SELECT sum(size * pow(v - g, 2)) AS b FROM {CENTROIDS} JOIN g USING (slot) JOIN s USING (cluster)),
w AS (SELECT sum(pow(x.v - c.v, 2)) AS w FROM {VECTORS} x JOIN {CENTROIDS} c USING (cluster, slot)), n AS (SELECT count(*) AS k, CAST(sum(size) AS BIGINT) AS n FROM s) SELECT k, n, round(b * (n - k) / (w * (k - 1)), 4) AS calinski_harabasz FROM b, w, n""")
def calinski_harabasz(spark, sf):
    return composition.calinski_harabasz(_long(spark, sf)).withColumn("calinski_harabasz", F.round("calinski_harabasz", 4))


@register("davies_bouldin", f"""WITH d AS (SELECT cluster, key, sqrt(sum(pow(x.v - c.v, 2))) AS d FROM {VECTORS} x JOIN {CENTROIDS} c USING (cluster, slot) GROUP BY ALL), s AS (SELECT cluster, avg(d) AS s FROM d GROUP BY cluster),
m AS (SELECT a.cluster AS a, b.cluster AS b, sqrt(sum(pow(a.v - b.v, 2))) AS m FROM {CENTROIDS} a JOIN {CENTROIDS} b USING (slot) WHERE a.cluster <> b.cluster GROUP BY ALL), r AS (SELECT a, max((x.s + y.s) / m) AS r FROM m JOIN s x ON x.cluster = a JOIN s y ON y.cluster = b GROUP BY a)
SELECT count(*) AS k, round(avg(r), 4) AS davies_bouldin FROM r""")
def davies_bouldin(spark, sf):
    return composition.davies_bouldin(_long(spark, sf)).withColumn("davies_bouldin", F.round("davies_bouldin", 4))


@register("silhouette", """WITH p AS (SELECT a.vec_id AS ka, a.label AS ca, b.label AS cb, sum(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS s, count(*) AS n FROM embeddings a CROSS JOIN embeddings b GROUP BY ALL),
e AS (SELECT ka, max(CASE WHEN ca = cb THEN s / nullif(n - 1, 0) END) AS a, min(CASE WHEN ca <> cb THEN s / n END) AS b, max(CASE WHEN ca = cb THEN n END) AS size FROM p GROUP BY ka)
SELECT count(*) AS n, round(avg(CASE WHEN size = 1 THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END), 5) AS silhouette FROM e""")
def silhouette(spark, sf):
    return composition.silhouette(vectors(spark, sf), "key", "cluster", "features").withColumn("silhouette", F.round("silhouette", 5))


@register("cluster_stats", f"""WITH s AS (SELECT cluster, count(DISTINCT key) AS size FROM {VECTORS} GROUP BY cluster), c AS (SELECT cluster, slot, v, row_number() OVER (PARTITION BY cluster ORDER BY v DESC, slot) AS up, row_number() OVER (PARTITION BY cluster ORDER BY v, slot) AS down FROM {CENTROIDS})
SELECT cluster, size, round(100.0 * size / sum(size) OVER (), 2) AS pct, max(CASE WHEN up = 1 THEN slot END) AS peak_slot, max(CASE WHEN down = 1 THEN slot END) AS trough_slot, round(max(v), 5) AS max, round(min(v), 5) AS min, round(avg(v), 5) AS mean,
(SELECT round(avg(sd), 5) FROM (SELECT stddev_samp(v) AS sd FROM {VECTORS} x WHERE x.cluster = c.cluster GROUP BY slot)) AS mean_std,
(SELECT round(coalesce(avg(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 0), 4) FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.label = c.cluster) AS mean_distance FROM c JOIN s USING (cluster) GROUP BY cluster, size""")
def cluster_stats(spark, sf):
    got = composition.stats(_long(spark, sf))
    got = got.join(composition.mean_distances(vectors(spark, sf), "key", "cluster", "features"), "cluster")
    return got.select("cluster", "size", "pct", "peak_slot", "trough_slot", *[F.round(c, 5).alias(c) for c in ("max", "min", "mean", "mean_std")], F.round("mean_distance", 4).alias("mean_distance"))


@register("cluster_band", f"SELECT cluster, CAST(slot AS INT) AS slot, round(avg(v), 5) AS mean, round(avg(v) - stddev_samp(v), 5) AS low, round(avg(v) + stddev_samp(v), 5) AS high FROM {VECTORS} GROUP BY ALL")
def cluster_band(spark, sf):
    got = profiles.sigma_band(_long(spark, sf), ["cluster", "slot"], "v", clip=False)
    return got.select("cluster", "slot", *[F.round(c, 5).alias(c) for c in ("mean", "low", "high")])


@register("cluster_sizes", "SELECT label AS cluster, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM embeddings GROUP BY label")
def cluster_sizes(spark, sf):
    return funnel.share(vectors(spark, sf), ["cluster"], [])


@register("cluster_dominant", "SELECT code, cluster, n, pct FROM (SELECT code, cluster, n, round(100.0 * n / sum(n) OVER (PARTITION BY code), 2) AS pct, row_number() OVER (PARTITION BY code ORDER BY n DESC, cluster) AS rn FROM (SELECT vec_id % 7 AS code, label AS cluster, count(*) AS n FROM embeddings GROUP BY ALL)) WHERE rn = 1")
def cluster_dominant(spark, sf):
    return funnel.dominant(vectors(spark, sf).withColumn("code", F.col("key") % 7), ["code"], "cluster")


@register("elbow_k", f"""WITH c AS (SELECT k, cluster % k AS c, slot, v FROM {VECTORS} CROSS JOIN (SELECT CAST(range AS INT) AS k FROM range(2, 10))), i AS (SELECT k, sum(d) AS i FROM (SELECT k, pow(v - avg(v) OVER (PARTITION BY k, c, slot), 2) AS d FROM c) GROUP BY k),
d AS (SELECT k, CASE WHEN lag(i) OVER (ORDER BY k) > 0 THEN (lag(i) OVER (ORDER BY k) - i) / lag(i) OVER (ORDER BY k) END AS d FROM i)
SELECT coalesce(min(k) FILTER (d < (SELECT avg(d) FROM d)), min(k) FILTER (d IS NOT NULL)) AS elbow_k FROM d""")
def elbow_k(spark, sf):
    """The elbow over clusterings of the vectors into two to nine clusters."""
    long = _long(spark, sf).withColumn("k", F.explode(F.array(*map(F.lit, range(2, 10)))))
    each = composition.inertia(long.select(F.concat_ws("/", "k", "key").alias("key"), F.struct("k", (F.col("cluster") % F.col("k")).alias("c")).alias("cluster"), "slot", "v"))
    return composition.elbow(each.groupBy(F.col("cluster.k").alias("k")).agg(F.sum("within").alias("inertia")))


@register("cluster_average", f"""WITH RECURSIVE {AVERAGE}, l AS (SELECT grp, labels FROM c WHERE step = len(labels) - 4 AND len(labels) >= 5), u AS (SELECT p.grp, p.key, l.labels[p.i] AS label FROM p JOIN l USING (grp))
SELECT CAST(grp AS VARCHAR) AS grp, CAST(key AS VARCHAR) AS key, min(CAST(key AS VARCHAR)) OVER (PARTITION BY grp, label) AS cluster, CAST(4 AS INT) AS k FROM u""")
def cluster_average(spark, sf):
    """Average linkage by group, cut into four; clusters by their least key."""
    return _by_least_key(clustering.assign(_profiles(spark, sf), "grp", "key", "features", 4))


@register("auto_k_vote", f"{SETS} SELECT CAST(grp AS VARCHAR) AS grp, method, CAST(k AS INT) AS k FROM vote UNION ALL SELECT CAST(grp AS VARCHAR), 'chosen', CAST(k AS INT) FROM chosen")
def auto_k_vote(spark, sf):
    return clustering.vote_table(_profiles(spark, sf), "grp", "key", "features")


@register("gap_statistic", f"{SETS} SELECT CAST(grp AS VARCHAR) AS grp, CAST(k AS INT) AS k, round(gap, 6) AS gap FROM f")
def gap_statistic(spark, sf):
    return clustering.gap_table(_profiles(spark, sf), "grp", "key", "features").withColumn("gap", F.round("gap", 6))


@register("dendrogram", f"""WITH RECURSIVE {AVERAGE} SELECT CAST(grp AS VARCHAR) AS grp, step - 1 AS step, CAST(least(a, b) AS INT) AS a, CAST(greatest(a, b) AS INT) AS b, round(height, 6) AS distance, CAST(len(list_filter(ids, lambda x: x = len(ids) + step - 1)) AS INT) AS size FROM c WHERE step > 0""")
def dendrogram(spark, sf):
    return clustering.merges(_profiles(spark, sf), "grp", "key", "features").withColumn("distance", F.round("distance", 6))


@register("dendrogram_cut", f"""WITH RECURSIVE {AVERAGE} SELECT CAST(grp AS VARCHAR) AS grp, round(height, 6) AS height FROM c WHERE step = len(labels) - 3 AND step > 0""")
def dendrogram_cut(spark, sf):
    """The height at which each tree falls into four."""
    return clustering.cut_heights(_profiles(spark, sf), "grp", "key", "features", 4).withColumn("height", F.round("height", 6))


@register("outliers_single_linkage", f"WITH {OUTLIERS} SELECT * FROM f")
def outliers_single_linkage(spark, sf):
    """Clusters by their least key."""
    return _by_least_key(clustering.outliers(_profiles(spark, sf), "grp", "key", "features"))


@register("outlier_report", f"""WITH {OUTLIERS}, g AS (SELECT CAST(key AS VARCHAR) AS key, count(DISTINCT ts::DATE) AS n_days, min(ts::DATE) AS first, max(ts::DATE) AS last, date_diff('day', min(ts::DATE), max(ts::DATE)) + 1 AS expected FROM {READINGS} GROUP BY key)
SELECT f.*, n_days, first, last, expected, greatest(0, expected - n_days) AS missing, round(100.0 * greatest(0, expected - n_days) / expected, 2) AS missing_pct FROM f LEFT JOIN g USING (key)""")
def outlier_report(spark, sf):
    found = _by_least_key(clustering.outliers(_profiles(spark, sf), "grp", "key", "features"))
    return clustering.outlier_report(found, readings(spark, sf).withColumnRenamed("key", "user"), "user", "ts")


@register("outlier_composition", f"WITH {OUTLIERS} SELECT segment, n, round(100.0 * n / sum(n) OVER (), 2) AS pct FROM (SELECT segment, count(*) AS n FROM f LEFT JOIN {PLACES} p ON CAST(p.key AS VARCHAR) = f.key GROUP BY segment)")
def outlier_composition(spark, sf):
    """What the outliers are, by segment."""
    found = clustering.outliers(_profiles(spark, sf), "grp", "key", "features")
    dim = places(spark, sf).select(F.col("key").cast("string").alias("key"), "segment")
    return funnel.share(found.join(dim, "key", "left"), ["segment"], [])


@register("single_linkage_at_distance", f"""WITH RECURSIVE p AS (SELECT key, list(v ORDER BY hour) AS q FROM (SELECT k.key, h.hour, coalesce(round(avg(value), 6), 0) AS v FROM (SELECT DISTINCT key FROM {READINGS}) k CROSS JOIN (SELECT range AS hour FROM range(24)) h LEFT JOIN {READINGS} r ON r.key = k.key AND hour(r.ts) = h.hour GROUP BY ALL) GROUP BY key),
e AS (SELECT a.key AS a, b.key AS b FROM p a JOIN p b ON a.key % 5 = b.key % 5 AND list_distance(a.q, b.q) <= 150), c(a, b) AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT a AS key, min(b) AS cluster FROM c GROUP BY a""")
def single_linkage_at_distance(spark, sf):
    """Single linkage of each group of keys cut at a distance: components of the merges below it, named by their least key."""
    h = readings(spark, sf).groupBy("key", F.hour("ts").alias("hour")).agg(F.round(F.avg("value"), 6).alias("v"))
    grid = h.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("hour", "v"))).alias("m"))
    q = grid.select("key", F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias("features"), (F.col("key") % 5).alias("grp"))
    # Keys of one length sort as numbers do.
    got = clustering.at_distance(q.withColumn("name", F.format_string("%019d", "key")), "grp", "name", "features", 150)
    return got.select(F.col("key").cast("long").alias("key"), F.col("cluster").cast("long").alias("cluster"))


EVENTS = f"(SELECT *, CAST(key % 4 AS INT) AS cluster, CAST(key % 3 AS INT) AS other FROM {READINGS})"


def _members(spark, sf):
    """Readings with two given labels of their keys."""
    return readings(spark, sf).withColumns({"cluster": (F.col("key") % 4).cast("int"), "other": (F.col("key") % 3).cast("int")})


@register("cluster_monthly_profile", f"SELECT cluster, CAST(month(ts) AS INT) AS month, CAST(hour(ts) AS INT) AS hour, round(avg(value), 5) AS v FROM {EVENTS} GROUP BY ALL")
def cluster_monthly_profile(spark, sf):
    """Profiles of fixed clusters by month."""
    return _members(spark, sf).groupBy("cluster", F.month("ts").alias("month"), F.hour("ts").alias("hour")).agg(F.round(F.avg("value"), 5).alias("v"))


@register("cluster_typology", f"SELECT cluster, kind, count(DISTINCT key) AS n, round(100.0 * count(DISTINCT key) / sum(count(DISTINCT key)) OVER (PARTITION BY cluster), 2) AS pct FROM {EVENTS} GROUP BY cluster, kind")
def cluster_typology(spark, sf):
    return funnel.share(_members(spark, sf).select("cluster", "kind", "key").distinct(), ["cluster", "kind"], ["cluster"])


@register("cluster_other_level", f"SELECT key, min(cluster) AS cluster, min(other) AS other FROM {EVENTS} GROUP BY key")
def cluster_other_level(spark, sf):
    """Each key's cluster of one level beside that of another."""
    m = _members(spark, sf)
    one = m.select("key", "cluster").distinct()
    return one.join(m.select("key", "other").distinct(), "key", "left")


@register("measures_with_cluster", f"SELECT event_id, e.user_id AS key, CAST(e.user_id % 4 AS INT) AS cluster, c_mktsegment AS segment, value FROM events e LEFT JOIN customer ON c_custkey = e.user_id")
def measures_with_cluster(spark, sf):
    r = readings(spark, sf)
    labels = r.select("key").distinct().withColumn("cluster", (F.col("key") % 4).cast("int"))
    return r.join(labels, "key", "left").join(places(spark, sf).select("key", "segment"), "key", "left").select("event_id", "key", "cluster", "segment", "value")


@register("cross_level_correlation", f"""WITH c AS (SELECT 'a:' || cluster AS name, CAST(hour(ts) AS INT) AS slot, avg(value) AS v FROM {EVENTS} GROUP BY ALL UNION ALL SELECT 'b:' || other, CAST(hour(ts) AS INT), avg(value) FROM {EVENTS} GROUP BY ALL)
SELECT a.name AS a, b.name AS b, count(*) AS n, round(covar_pop(a.v, b.v) / nullif(stddev_pop(a.v) * stddev_pop(b.v), 0), 5) AS r FROM c a JOIN c b USING (slot) WHERE a.name < b.name GROUP BY ALL""")
def cross_level_correlation(spark, sf):
    from ..operators import comparison

    long = _members(spark, sf).withColumn("slot", F.hour("ts"))
    one = lambda c: long.groupBy(F.col(c).alias("cluster"), "slot").agg(F.avg("value").alias("v"))
    return comparison.cross_level({"a": one("cluster"), "b": one("other")}).withColumn("r", F.round("r", 5))


@register("sorted_columns", "SELECT label AS cluster, rank FROM (SELECT label, CAST(row_number() OVER (ORDER BY count(*) DESC, label) AS INT) AS rank FROM embeddings GROUP BY label)")
def sorted_columns(spark, sf):
    """The order of a cross-table's columns: by their totals."""
    from pyspark.sql.window import Window

    n = vectors(spark, sf).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return n.select("cluster", F.row_number().over(Window.orderBy(F.col("n").desc(), "cluster")).alias("rank"))


#: The next two in SQL, which takes minutes over more than a few users a month; tests hold them against it on the smallest tables.
MONTHLY_SQL = f"""{MONTHS} SELECT CAST(p.grp AS VARCHAR) AS grp, CAST(key AS VARCHAR) AS key, min(CAST(key AS VARCHAR)) OVER (PARTITION BY p.grp, l.c) AS cluster, CAST(l.k AS INT) AS k
FROM p JOIN chosen USING (grp) JOIN l ON l.grp = p.grp AND l.ref = -1 AND l.k = chosen.k AND l.i = p.i"""
K_SQL = f"{MONTHS} SELECT {', '.join(f'CAST(max(k) FILTER (grp = {m}) AS INT) AS {chr(34)}{m}{chr(34)}' for m in range(1, 13))} FROM chosen"


@register("monthly_recluster")
def monthly_recluster(spark, sf):
    """Each of the twelve months clustered anew with its own k; clusters by their least key."""
    return _by_least_key(clustering.assign(_months(spark, sf), "grp", "key", "features"))


def _months(spark, sf):
    """Users' hours by month as vectors."""
    h = _by_user(spark, sf).groupBy("key", F.month("ts").alias("grp"), F.hour("ts").alias("hour")).agg(F.avg("value").alias("v"))
    grid = h.groupBy("key", "grp").agg(F.map_from_entries(F.collect_list(F.struct("hour", "v"))).alias("m"))
    q = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)))
    return grid.select("key", "grp", q.alias("features"))


@register("k_per_group")
def k_per_group(spark, sf):
    """One row with the k of each group."""
    got = clustering.vote_table(_months(spark, sf), "grp", "key", "features").where("method = 'chosen'")
    return got.groupBy().pivot("grp", [str(m) for m in range(1, 13)]).agg(F.max("k"))
