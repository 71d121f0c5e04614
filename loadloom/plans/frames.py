"""The driver's tables in the roles that the operators name: keys, times, values, groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table


def orders(spark: SparkSession, sf: str) -> DataFrame:
    """Metered points are customers, readings their orders."""
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("value"), "o_orderkey", "o_orderpriority")


def places(spark: SparkSession, sf: str) -> DataFrame:
    """The dimension of customers with nation and region. The two small tables are joined as Spark decides by their size."""
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.col("c_acctbal").alias("balance"))


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """Metered points are users, readings their events. The events of one month are dealt over twelve, so that rules of months have several."""
    ts = F.col("ts") + F.make_ym_interval(F.lit(0), (F.col("event_id") % 12).cast("int"))
    return table(spark, sf, "events").select(F.col("user_id").alias("key"), ts.alias("ts"), "value", F.col("event_type").alias("kind"), "event_id")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_partkey").alias("part"), F.col("l_shipdate").alias("ts"), F.col("l_extendedprice").alias("value"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.col("label").alias("cluster"), F.col("embedding").alias("features"))


#: The same in SQL.
ORDERS = "(SELECT o_custkey AS key, o_orderdate AS ts, o_totalprice AS value, o_orderkey, o_orderpriority FROM orders)"
PLACES = "(SELECT c_custkey AS key, c_mktsegment AS segment, n_name AS nation, r_name AS region, c_acctbal AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
READINGS = "(SELECT user_id AS key, ts + to_months(CAST(event_id % 12 AS INTEGER)) AS ts, value, event_type AS kind, event_id FROM events)"
LINES = "(SELECT l_suppkey AS key, l_partkey AS part, l_shipdate AS ts, l_extendedprice AS value, l_quantity AS quantity, l_returnflag AS flag, l_linestatus AS status FROM lineitem)"
VECTORS = "(SELECT key, cluster, unnest(range(len(embedding))) AS slot, unnest(embedding)::DOUBLE AS v FROM (SELECT vec_id AS key, label AS cluster, embedding FROM embeddings))"
