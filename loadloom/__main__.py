"""python -m loadloom ANALYSIS ROOT OUT: the analyses over a folder of monthly folders."""

from __future__ import annotations

import argparse
import io
import logging

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import cleaning, taxonomy
from .operators import clustering, comparison, composition, funnel, profiles
from .operators.ranking import held
from .sources import files, references, reports, store

log = logging.getLogger("loadloom")


def dimension(tables):
    """The latest metadata of each key with levels and contract power."""
    meta = funnel.latest(tables["meta"], "pod", ["periodo", "row_ord"])
    dim = taxonomy.levels(meta, "ccatete")
    dim = dim.withColumns({c: cleaning.sentinel(F.col(c)) for c in ("l1", "l2", "l3")})
    return taxonomy.reclassify(dim, "fdesc").join(tables["power"], "pod", "left")


def vectors(meas):
    """Mean scaled profile of each key as one vector."""
    long = profiles.daily_profiles(meas, "pod", "date", "q").groupBy("pod", "slot").agg(F.avg("norm").alias("v"))
    return long.groupBy("pod").agg(F.array_sort(F.collect_list(F.struct("slot", "v"))).alias("p")).select("pod", F.transform("p", lambda s: s["v"]).alias("features"))


def main() -> None:
    parser = argparse.ArgumentParser(prog="loadloom", description=__doc__)
    parser.add_argument("analysis", choices=["funnel", "profiles", "cluster", "compare", "outliers"])
    parser.add_argument("root")
    parser.add_argument("out")
    parser.add_argument("--reference", help="workbook of the national hourly profiles")
    parser.add_argument("--provincial", help="folder of the provincial workbooks by class of power")
    parser.add_argument("--power-class", default="1.5–3 kW", help="class of contract power for the provincial comparison")
    parser.add_argument("--province", default="Trento")
    parser.add_argument("--kind", default="AP", help="measure type; all if there is none of it")
    parser.add_argument("--clusters", type=int, default=None)
    args = parser.parse_args()
    said = io.StringIO()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s", handlers=[logging.StreamHandler(), logging.StreamHandler(said)])
    spark = SparkSession.builder.appName("loadloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        analyse(spark, args)
    finally:
        files.save(f"{args.out}/run.log", said.getvalue().encode())


def analyse(spark: SparkSession, args: argparse.Namespace) -> None:
    """One analysis, its files in the folder of results, which may be in any store."""
    tables = store.load_cached(spark, args.root)
    for issue in tables["issues"].collect():
        log.warning("%s", issue)
    meas = funnel.kind_or_all(tables["meas"].withColumn("tipologia", F.coalesce("tipologia", F.lit(""))), "tipologia", args.kind)
    dim = dimension(tables)

    def save(name: str, data: bytes) -> None:
        files.save(f"{args.out}/{name}", data)
        log.info("wrote %s", name)

    if args.analysis == "funnel":
        save("summary.xlsx", reports.summary_workbook(dim, comparison.hour_rows(meas), "d49"))
    elif args.analysis == "profiles":
        profiles.daily_profiles(meas, "pod", "date", "q").write.mode("overwrite").parquet(f"{args.out}/profiles.parquet")
    elif args.analysis == "compare":
        reference = references.national(spark, args.reference).withColumnsRenamed({"mese": "month", "ora": "hour"})
        means = reference.groupBy("month", "hour").agg(*[F.avg(c).alias(c) for c in ("PDMM", "PDMF", "PAUM", "PAUF")])
        large = f"{args.out}/tables"
        rows = held(comparison.hour_rows(meas))
        monthly, annual, ranking = comparison.code_metrics(rows, dim, means, "pod")
        save("comparison.zip", reports.comparison_bundle(monthly, comparison.monthly_quality(monthly), ranking, annual, large))
        save("national.zip", reports.national_bundle(*comparison.national_comparison(rows, dim, means, "pod"), large=large))
        if args.provincial:
            hourly = references.for_power_class(spark, args.provincial, args.power_class, args.province)
            homes = comparison.homes(dim, "pod", "potcontr_kw", args.power_class)
            energy, shape = comparison.provincial_metrics(rows, homes, hourly, "pod")
            own = profiles.by_day_type(rows.join(homes, "pod"), "pod", "ts", "value", 1 / 1000, ("residence",))
            save("provincial.zip", reports.provincial_bundle(energy, shape, own, large))
    else:
        v = held(vectors(meas).join(dim.select("pod", "l1", "l2", "l3"), "pod", "left"))
        if args.analysis == "cluster":
            levels = {}
            for level in ("l1", "l2", "l3"):
                grouped = v.withColumn("grp", F.coalesce(level, F.lit("N/A")))
                found = clustering.assign(grouped, "grp", "pod", "features", args.clusters)
                own = held(found.select(F.col("key").alias("pod"), F.concat_ws("-", "grp", "cluster").alias("cluster")))
                levels[level] = own, composition.long_form(v.join(own, "pod"), "pod", "cluster", "features")
            months = profiles.packed_months(meas, "pod", "date", "q")
            chosen = clustering.vote_table(months, "month", "pod", "features").where("method = 'chosen'").select(F.col("grp").cast("int").alias("month"), "k")
            save("clustering.zip", reports.levels_bundle(levels, dim, chosen, issues=tables["issues"], large=f"{args.out}/tables"))
        else:
            got = held(clustering.outliers(v.withColumn("grp", F.lit("all")), "grp", "pod", "features", args.clusters or 20))
            gaps = funnel.gaps(meas.join(got.select(F.col("key").alias("pod")), "pod", "left_semi"), "pod", "date")
            save("outliers.zip", reports.outlier_bundle(got, dim, "l1", "pod", gaps, large=f"{args.out}/tables"))


if __name__ == "__main__":
    main()
