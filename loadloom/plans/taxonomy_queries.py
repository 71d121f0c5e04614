"""Queries of codes, levels, labels and typed texts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import cleaning, taxonomy, text
from ..operators import comparison, composition, funnel
from .frames import PLACES, READINGS, places, readings
from .registry import register

# A dotted code of one to three parts from a part's number, brand and size.
CODE = "CASE CAST(p_partkey % 7 AS INT) WHEN 0 THEN 'DO.' || lpad(CAST(p_size % 4 AS VARCHAR), 2, '0') WHEN 1 THEN chr(CAST(65 + p_size % 20 AS INT)) WHEN 2 THEN '' WHEN 3 THEN CAST(p_size AS VARCHAR) || '.' ELSE CAST(p_size AS VARCHAR) || '.' || substr(p_brand, 7, 1) || '.' || substr(p_brand, 8, 1) END"
PARTS = f"(SELECT p_partkey AS key, {CODE} AS code, p_type AS fdesc, p_name AS name FROM part)"


def _lvl(n: int) -> str:
    parts = "string_split(trim(code), '.')"
    return f"CASE WHEN len({parts}) >= {n} AND len(list_filter({parts}[1:{n}], lambda x: trim(x) = '')) = 0 THEN array_to_string({parts}[1:{n}], '.') END"


LEVELS = f"(SELECT key, code, fdesc, {_lvl(1)} AS l1, {_lvl(2)} AS l2, {_lvl(3)} AS l3 FROM {PARTS})"


def _parts(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    size, k = F.col("p_size"), F.col("p_partkey") % 7
    two = F.concat(size.cast("string"), F.lit("."), F.substring("p_brand", 7, 1), F.lit("."), F.substring("p_brand", 8, 1))
    code = F.when(k == 0, F.concat(F.lit("DO."), F.lpad((size % 4).cast("string"), 2, "0"))).when(k == 1, F.char(65 + size % 20)).when(k == 2, "").when(k == 3, F.concat(size.cast("string"), F.lit("."))).otherwise(two)
    return p.select(F.col("p_partkey").alias("key"), code.alias("code"), F.col("p_type").alias("fdesc"), F.col("p_name").alias("name"))


def _levels(spark, sf):
    return taxonomy.levels(_parts(spark, sf), "code")


@register("taxonomy_split", f"SELECT key, code, l1, l2, l3 FROM {LEVELS}")
def taxonomy_split(spark, sf):
    return _levels(spark, sf).select("key", "code", "l1", "l2", "l3")


TITLES = f"(SELECT code, min(name) AS title FROM {PARTS} WHERE key % 3 = 0 AND code <> '' GROUP BY code)"


@register("taxonomy_prefix_lookup", f"""WITH c AS (SELECT DISTINCT code FROM {PARTS}), b AS (SELECT c.code AS full, i AS n, array_to_string(string_split(c.code, '.')[1:i], '.') AS code FROM c, range(1, 4) r(i) WHERE i <= len(string_split(c.code, '.')))
SELECT p.key, coalesce(t.title, '') AS description FROM {PARTS} p LEFT JOIN (SELECT b.full, max_by(t.title, n) AS title FROM b JOIN {TITLES} t ON b.code = t.code GROUP BY b.full) t ON t.full = p.code""")
def taxonomy_prefix_lookup(spark, sf):
    p = _parts(spark, sf)
    titles = p.where("key % 3 = 0 AND code <> ''").groupBy("code").agg(F.min("name").alias("title"))
    return taxonomy.describe(p, "code", titles).select("key", "description")


@register("taxonomy_rollup", f"SELECT l1, l2, l3, count(DISTINCT key) AS n_keys FROM {LEVELS} WHERE l1 IS NOT NULL AND l2 IS NOT NULL AND l3 IS NOT NULL GROUP BY ROLLUP (l1, l2, l3)")
def taxonomy_rollup(spark, sf):
    return _levels(spark, sf).where("l1 IS NOT NULL AND l2 IS NOT NULL AND l3 IS NOT NULL").rollup("l1", "l2", "l3").agg(F.countDistinct("key").alias("n_keys"))


LEGEND = f"(SELECT 1 AS level, l1 AS code, count(DISTINCT key) AS n FROM {LEVELS} WHERE l1 IS NOT NULL GROUP BY l1 UNION ALL SELECT 2, l2, count(DISTINCT key) FROM {LEVELS} WHERE l2 IS NOT NULL GROUP BY l2 UNION ALL SELECT 3, l3, count(DISTINCT key) FROM {LEVELS} WHERE l3 IS NOT NULL GROUP BY l3)"


def _legend(spark, sf):
    return composition.legend(_levels(spark, sf), "key", ["l1", "l2", "l3"])


@register("taxonomy_legend", f"SELECT * FROM {LEGEND}")
def taxonomy_legend(spark, sf):
    return _legend(spark, sf)


@register("legend_search", f"SELECT l.*, t.title FROM {LEGEND} l LEFT JOIN {TITLES} t USING (code) WHERE regexp_matches(code, '(?i)^(do|1)|gre') OR coalesce(regexp_matches(title, '(?i)^(do|1)|gre'), false)")
def legend_search(spark, sf):
    """Codes of the legend by a pattern over code and title."""
    titles = _parts(spark, sf).where("key % 3 = 0 AND code <> ''").groupBy("code").agg(F.min("name").alias("title"))
    return taxonomy.search(_legend(spark, sf).join(titles, "code", "left"), "^(do|1)|gre", title="title")


@register("level_counts", f"SELECT l1, n, round(100.0 * n / sum(n) OVER (), 2) AS pct FROM (SELECT l1, count(*) AS n FROM {LEVELS} GROUP BY l1)")
def level_counts(spark, sf):
    return funnel.share(_levels(spark, sf), ["l1"], [])


HOME = "CASE WHEN fdesc LIKE '%NON RESID%' THEN 'DO.NR' WHEN fdesc LIKE '%RESID%' OR fdesc LIKE '%DOMESTIC%' THEN 'DO.R' END"
SUPPLY = "CASE WHEN key % 11 = 0 THEN 'USI DOMESTICI NON RESID.' WHEN key % 11 = 1 THEN 'USO DOMESTICO RESID.' ELSE upper(fdesc) END"
RECLASS = f"""(WITH s AS (SELECT key, {SUPPLY} AS fdesc, coalesce(CASE WHEN l1 = 'DO' AND key % 2 = 0 THEN 'DOX' ELSE l1 END, 'N/A') AS l1, coalesce(l2, 'N/A') AS l2, coalesce(l3, 'N/A') AS l3 FROM {LEVELS}), a AS (SELECT key, CASE WHEN {HOME} IS NOT NULL THEN 'DO' ELSE l1 END AS l1, coalesce({HOME}, l2) AS l2, CASE WHEN {HOME} IS NOT NULL THEN 'N/A' ELSE l3 END AS l3 FROM s)
SELECT key, CASE WHEN o THEN 'DO' ELSE l1 END AS l1, CASE WHEN NOT o THEN l2 WHEN l2 IN ('DO.R', 'DO.NR') THEN l2 ELSE 'DO.R' END AS l2, CASE WHEN o THEN 'N/A' ELSE l3 END AS l3 FROM (SELECT *, l1 LIKE 'DO%' AND l1 <> 'DO' AS o FROM a))"""


def _reclass(spark, sf):
    k = F.col("key")
    s = _levels(spark, sf).withColumn("fdesc", F.when(k % 11 == 0, "USI DOMESTICI NON RESID.").when(k % 11 == 1, "USO DOMESTICO RESID.").otherwise(F.upper("fdesc")))
    s = s.withColumns({c: cleaning.sentinel(F.when((F.col("l1") == "DO") & (k % 2 == 0), "DOX").otherwise(F.col("l1")) if c == "l1" else F.col(c)) for c in ("l1", "l2", "l3")})
    return taxonomy.reclassify(s, "fdesc").select("key", "l1", "l2", "l3")


@register("domestic_reclass", f"SELECT * FROM {RECLASS}")
def domestic_reclass(spark, sf):
    return _reclass(spark, sf)


@register("reference_router", f"SELECT l1, CASE WHEN l1 IN ('IL', 'N/A') THEN NULL WHEN l1 = 'DO' THEN 'PDMM' ELSE 'PAUM' END AS mono, CASE WHEN l1 IN ('IL', 'N/A') THEN NULL WHEN l1 = 'DO' THEN 'PDMF' ELSE 'PAUF' END AS bands, count(*) AS n FROM {RECLASS} GROUP BY ALL")
def reference_router(spark, sf):
    got = _reclass(spark, sf).withColumn("r", taxonomy.reference_columns(F.col("l1")))
    return got.groupBy("l1", F.col("r.mono").alias("mono"), F.col("r.bands").alias("bands")).agg(F.count(F.lit(1)).alias("n"))


@register("group_predicates", f"SELECT * FROM (SELECT CASE WHEN l2 = 'DO.R' THEN 'DO.R' WHEN l2 = 'DO.NR' THEN 'DO.NR' WHEN l1 NOT LIKE 'DO%' AND l1 NOT LIKE 'IL%' AND l1 <> 'N/A' THEN 'Other' END AS grp, count(*) AS n FROM {RECLASS} GROUP BY ALL) WHERE grp IS NOT NULL")
def group_predicates(spark, sf):
    return comparison.groups(_reclass(spark, sf)).groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


@register("label_typology", f"SELECT key, substr(region, 1, 20) || ' | ' || substr(nation, 1, 20) || ' | ' || substr(segment, 1, 35) AS label, CASE WHEN nation = 'NATION_3' THEN NULL ELSE substr(nation, 1, 25) || ' | ' || substr(segment, 1, 30) END AS two FROM {PLACES}")
def label_typology(spark, sf):
    nation = F.when(F.col("nation") != "NATION_3", F.col("nation"))
    return places(spark, sf).select("key", text.typology_label(F.col("region"), F.col("nation"), F.col("segment")).alias("label"), text.typology_label(nation, F.col("segment")).alias("two"))


@register("label_coalesce", f"""SELECT key, CASE WHEN l3 IS NOT NULL THEN l3 || ' | ' || substr(fdesc, 1, 45) WHEN l2 IS NOT NULL THEN l2 || ' | ' || substr(fdesc, 1, 45) WHEN l1 IS NOT NULL THEN l1 || ' | ' || substr(fdesc, 1, 45) WHEN key % 2 = 0 THEN substr(fdesc, 1, 10) ELSE 'Unknown' END AS label FROM {LEVELS}""")
def label_coalesce(spark, sf):
    p = _levels(spark, sf)
    other = F.when(F.col("key") % 2 == 0, F.col("fdesc"))
    return p.select("key", text.code_label([F.col("l3"), F.col("l2"), F.col("l1")], [F.col("fdesc")] * 3, [other], other_length=10).alias("label"))


@register("best_description", f"SELECT key, coalesce(CASE WHEN l3 <> '' THEN l3 END, CASE WHEN l2 <> '' THEN l2 END, CASE WHEN l1 <> '' THEN l1 END, '') AS description FROM {LEVELS}")
def best_description(spark, sf):
    return _levels(spark, sf).select("key", taxonomy.best_description(F.col("l3"), F.col("l2"), F.col("l1")).alias("description"))


@register("decimal_comma_parse", """WITH t AS (SELECT event_id, CASE CAST(event_id % 4 AS INT) WHEN 0 THEN ' ' || replace(CAST(round(value, 2) AS VARCHAR), '.', ',') || ' ' WHEN 1 THEN '1.234,5' WHEN 2 THEN 'x' ELSE CAST(round(value, 1) AS VARCHAR) END AS s FROM events)
SELECT event_id, TRY_CAST(replace(trim(s), ',', '.') AS DOUBLE) AS v FROM t""")
def decimal_comma_parse(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    k = F.col("event_id") % 4
    s = F.when(k == 0, F.concat(F.lit(" "), F.replace(F.round("value", 2).cast("string"), F.lit("."), F.lit(",")), F.lit(" "))).when(k == 1, "1.234,5").when(k == 2, "x").otherwise(F.round("value", 1).cast("string"))
    return e.select("event_id", cleaning.decimal_comma(s).alias("v"))


@register("key_normalise", "SELECT CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'IT' || user_id WHEN 1 THEN 'IT' || user_id ELSE 'NAN' END AS key, count(*) AS n FROM events WHERE event_id % 3 < 2 GROUP BY ALL")
def key_normalise(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    k = F.col("event_id") % 3
    raw = F.when(k == 0, F.concat(F.lit(" it"), F.col("user_id"), F.lit(".0 "))).when(k == 1, F.concat(F.lit("IT"), F.col("user_id"))).otherwise("nan")
    got = e.select(cleaning.normalize_key(raw).alias("key"))
    return got.where(cleaning.is_valid_key(F.col("key"))).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@register("date_parse", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts::DATE END AS d FROM events")
def date_parse(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    s = F.when(F.col("event_id") % 5 == 0, "bad").otherwise(F.date_format("ts", "dd/MM/yyyy"))
    return e.select("event_id", cleaning.day_first(s).alias("d"))


@register("percent_parse", "SELECT event_id, round(value, 2) AS marked, round(round(value, 2) * 100, 2) AS plain FROM events")
def percent_parse(spark, sf):
    """A column with one % is a percentage throughout; one without is a share."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    s = F.round("value", 2).cast("string")
    e = e.select("event_id", F.replace(F.when(F.col("event_id") % 100 == 0, F.concat(s, F.lit("%"))).otherwise(s), F.lit("."), F.lit(",")).alias("a"), s.alias("b"))
    got = cleaning.percent_column(cleaning.percent_column(e, "a", "marked"), "b", "plain")
    return got.select("event_id", F.round("marked", 2).alias("marked"), F.round("plain", 2).alias("plain"))


@register("reference_calendar", "SELECT event_id, CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE month(ts) END AS INT) AS month, CAST(hour(ts) AS INT) AS hour FROM events")
def reference_calendar(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    day = F.when(F.col("event_id") % 3 == 0, "2024").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    day = F.when(F.length(day) == 4, "anno").otherwise(day)
    return e.select("event_id", cleaning.reference_month(day).alias("month"), cleaning.reference_hour(F.concat(F.lit("Ora"), F.hour("ts") + 1)).alias("hour"))


@register("crosstab_share_text", f"""WITH n AS (SELECT region, segment, count(*) AS n FROM {PLACES} GROUP BY ALL), c AS (SELECT region, segment, n || ' (' || CAST(CAST(round(100.0 * n / sum(n) OVER (PARTITION BY region), 1) AS DECIMAL(5,1)) AS VARCHAR) || '%)' AS cell FROM n)
SELECT region, coalesce(max(cell) FILTER (segment = 'BUILDING'), '—') AS "BUILDING", coalesce(max(cell) FILTER (segment = 'MACHINERY'), '—') AS "MACHINERY", coalesce(max(cell) FILTER (segment = 'NONE'), '—') AS "NONE" FROM c GROUP BY region""")
def crosstab_share_text(spark, sf):
    return composition.crosstab_text(places(spark, sf), "region", "segment", ["BUILDING", "MACHINERY", "NONE"])


@register("ranked_composition", f"SELECT region, segment, n, CAST(row_number() OVER (PARTITION BY region ORDER BY n DESC, segment) AS INT) AS rank, round(100.0 * n / sum(n) OVER (PARTITION BY region), 2) AS pct FROM (SELECT region, segment, count(*) AS n FROM {PLACES} GROUP BY ALL)")
def ranked_composition(spark, sf):
    return composition.ranked(places(spark, sf), "region", "segment")


@register("dominant_category", f"SELECT nation, segment, n, pct FROM (SELECT nation, segment, n, round(100.0 * n / sum(n) OVER (PARTITION BY nation), 2) AS pct, row_number() OVER (PARTITION BY nation ORDER BY n DESC, segment) AS rn FROM (SELECT nation, segment, count(*) AS n FROM {PLACES} GROUP BY ALL)) WHERE rn = 1")
def dominant_category(spark, sf):
    return funnel.dominant(places(spark, sf), ["nation"], "segment")


@register("distinct_labels", f"SELECT kind, string_agg(d, ' ' ORDER BY first) AS labels FROM (SELECT kind, dayname(ts) AS d, min(event_id) AS first FROM {READINGS} GROUP BY ALL) GROUP BY kind")
def distinct_labels(spark, sf):
    """Each label once, in the order in which they first come."""
    got = text.distinct_in_order(readings(spark, sf).withColumn("day", F.date_format("ts", "EEEE")), ["kind"], "day", "event_id")
    return got.select("kind", F.array_join("day", " ").alias("labels"))


@register("label_threshold", f"SELECT segment, n, CASE WHEN pct >= 20 THEN CAST(pct AS VARCHAR) || '%' ELSE '' END AS label FROM (SELECT segment, count(*) AS n, CAST(round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS DECIMAL(5,1)) AS pct FROM {PLACES} GROUP BY segment)")
def label_threshold(spark, sf):
    n = places(spark, sf).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    pct = F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1).cast("decimal(5,1)")
    return n.withColumn("p", pct).select("segment", "n", F.when(F.col("p") >= 20, F.concat(F.col("p").cast("string"), F.lit("%"))).otherwise("").alias("label"))


@register("thousands_text", "SELECT o_orderkey, replace(printf('%,d', o_orderkey * 1000), ',', chr(8239)) AS label FROM orders")
def thousands_text(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", text.thousands(F.col("o_orderkey") * 1000).alias("label"))


@register("power_resolver", f"SELECT kind, found, round(sum(balance), 2) AS total FROM {PLACES}, (VALUES ('Pot. impegnata', 'POTENZA x'), ('exact', 'POTCONTR'), ('case', 'potenza contrattuale')) t(kind, found) GROUP BY kind, found")
def power_resolver(spark, sf):
    """The column that the resolver finds in a table under three headers, and its sum."""
    heads = {"Pot. impegnata": ["POD", "POTENZA x"], "exact": ["a_potenza", "POTCONTR"], "case": ["x", "potenza contrattuale"]}
    out = None
    for kind, (key, value) in heads.items():
        df = places(spark, sf).select(F.col("key").alias(key), F.col("balance").alias(value))
        found = cleaning.resolve_power_column(df.columns)
        part = df.agg(F.round(F.sum(F.col(f"`{found}`")), 2).alias("total")).select(F.lit(kind).alias("kind"), F.lit(found).alias("found"), "total")
        out = part if out is None else out.unionByName(part)
    return out


