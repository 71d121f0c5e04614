"""Dotted codes: levels, titles and reclassification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Codes of distributors that the classification lacks, and their titles.
DISTRIBUTOR_CODES = {
    "DO": "Domestic (Resident + Non-Resident)", "DO.R": "Domestic - Resident", "DO.NR": "Domestic - Non-Resident",
    "CO": "Condominium services", "CO.01": "Condominium services - Resident", "CO.02": "Condominium services - Non-Resident",
    "IL": "Public lighting", "IL.01": "Public lighting",
    "DA": "Food products, beverages and tobacco", "DB": "Textiles and textile products", "DC": "Leather and leather products", "DD": "Wood and wood products",
    "DE": "Pulp, paper, publishing and printing", "DF": "Coke, petroleum products and nuclear fuel", "DG": "Chemicals and chemical products", "DH": "Rubber and plastic products",
    "DI": "Other non-metallic mineral products", "DJ": "Basic metals and fabricated metal products", "DK": "Machinery and equipment n.e.c.", "DL": "Electrical and optical equipment",
    "DM": "Transport equipment", "DN": "Manufacturing n.e.c.", "CA": "Mining of coal and lignite; extraction of peat", "CB": "Mining of metal ores",
}


def level(code: Column, n: int) -> Column:
    """The first n parts of a dotted code, null where it has fewer or the n-th is empty; an empty part before it stays."""
    parts = F.split(F.trim(code), r"\.")
    return F.when(F.get(parts, F.lit(n - 1)) != "", F.concat_ws(".", F.slice(parts, 1, n)))


def levels(df: DataFrame, code: str, names: tuple[str, str, str] = ("l1", "l2", "l3")) -> DataFrame:
    return df.withColumns({name: level(F.col(code), n) for n, name in enumerate(names, 1)})


def domestic(text: Column) -> Column:
    """DO.NR, DO.R or null from a supply description."""
    t = F.upper(F.trim(text))
    return F.when(t.contains("NON RESID"), "DO.NR").when(t.contains("RESID") | t.contains("DOMESTIC"), "DO.R")


def reclassify(df: DataFrame, description: str, names: tuple[str, str, str] = ("l1", "l2", "l3")) -> DataFrame:
    """Domestic descriptions overwrite all levels; then codes that begin with DO but aren't DO become domestic."""
    a, b, c = names
    home = domestic(F.col(description))
    df = df.withColumn("__home", home)
    df = df.withColumns({a: F.when(F.col("__home").isNotNull(), "DO").otherwise(F.col(a)), b: F.coalesce("__home", b), c: F.when(F.col("__home").isNotNull(), "N/A").otherwise(F.col(c))})
    other = F.col(a).startswith("DO") & (F.col(a) != "DO")
    df = df.withColumn("__other", F.coalesce(other, F.lit(False)))
    second = F.when(F.col(b).isin("DO.R", "DO.NR"), F.col(b)).otherwise("DO.R")
    df = df.withColumns({b: F.when(F.col("__other"), second).otherwise(F.col(b)), c: F.when(F.col("__other"), "N/A").otherwise(F.col(c)), a: F.when(F.col("__other"), "DO").otherwise(F.col(a))})
    return df.drop("__home", "__other")


def with_distributors(titles: DataFrame) -> DataFrame:
    """A table of ``code`` and ``title`` with the distributors' codes that it lacks."""
    own = titles.sparkSession.createDataFrame(list(DISTRIBUTOR_CODES.items()), "code string, title string")
    return titles.unionByName(own.join(titles.select("code"), "code", "left_anti"))


def describe(df: DataFrame, code: str, titles: DataFrame, out: str = "description") -> DataFrame:
    """The title of a code or of its longest dotted beginning that has one, else an empty text.

    Distinct codes are looked up, by equi-joins over their beginnings, and joined back.
    """
    codes = df.select(F.col(code).alias("__code")).where(F.col("__code").isNotNull()).distinct()
    parts = F.split("__code", r"\.")
    begins = codes.select("__code", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("n"), parts.alias("p"))
    begins = begins.select("__code", "n", F.concat_ws(".", F.slice("p", F.lit(1), F.col("n"))).alias("code"))
    best = begins.join(titles.select("code", "title"), "code").groupBy("__code").agg(F.max_by("title", "n").alias("__title"))
    return df.join(best, df[code] == best["__code"], "left").withColumn(out, F.coalesce("__title", F.lit(""))).drop("__code", "__title")


def best_description(*descriptions: Column) -> Column:
    """The first description that says something; name the most specific first."""
    return F.coalesce(*[F.when(F.trim(d) != "", d) for d in descriptions], F.lit(""))


def reference_columns(l1: Column) -> Column:
    """Which reference profiles a code is compared with: a struct of the mono-rate and the time-of-use one, or null."""
    pair = lambda m, f: F.struct(F.lit(m).alias("mono"), F.lit(f).alias("bands"))
    return F.when(l1.isNull() | l1.isin("IL", "N/A"), F.lit(None)).when(l1 == "DO", pair("PDMM", "PDMF")).otherwise(pair("PAUM", "PAUF"))


def search(df: DataFrame, pattern: str, code: str = "code", title: str = "description") -> DataFrame:
    """Rows whose code or title has the pattern, whatever the letter case."""
    found = F.col(code).rlike(f"(?i){pattern}") | F.col(title).rlike(f"(?i){pattern}")
    return df.where(F.coalesce(found, F.lit(False)))
