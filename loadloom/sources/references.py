"""Reference profiles and the classification, from workbooks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning
from ..functions.taxonomy import with_distributors
from . import files, xlsx

#: Files of the hourly reference by class of power (label of the class -> part of the file's name).
POWER_CLASS_FILES = {"≤ 1.5 kW": "0_a_1_5", "1.5–3 kW": "1_5_a_3", "3–4.5 kW": "3_a_4_5", "4.5–6 kW": "4_5_a_6", "> 6 kW": "potenza6"}


def sheet(spark: SparkSession, path: str, number: int | str = 0) -> DataFrame:
    """A sheet as texts with trimmed headers."""
    header, rows = xlsx.table(files.content(path), number)
    names = [h.strip() for h in header]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names)) if names else spark.createDataFrame([], "empty string")


def classification(spark: SparkSession, path: str, code: str = "CODICE_ATECO_2025", title: str = "TITOLO_ITALIANO_ATECO_2025") -> DataFrame:
    """``code`` and ``title``, one row a code, blanks dropped, with the distributors' codes."""
    raw = sheet(spark, path, 1).select(F.trim(code).alias("code"), F.trim(title).alias("title"))
    raw = raw.where(F.col("code").isNotNull() & ~F.lower("code").isin("", "nan"))
    return with_distributors(raw.groupBy("code").agg(F.min("title").alias("title")))


def national(spark: SparkSession, path: str) -> DataFrame:
    """``anno, mese, giorno, ora`` and every other column as a percentage; rows without month or hour dropped."""
    df = sheet(spark, path)
    calendar = {c: c.lower() for c in ("Anno", "Mese", "Giorno", "Ora")}
    # Names differ by case alone, so the numbers take the place of the texts.
    out = df.select(*[cleaning.decimal_comma(F.col(c)).cast("int").alias(calendar[c]) if c in calendar else F.col(f"`{c}`") for c in df.columns])
    for c in df.columns:
        if c not in calendar:
            out = cleaning.percent_column(out, c, c)
    return out.na.drop(subset=["mese", "ora"])


def provincial(spark: SparkSession, path: str, province: str = "Trento", market: str | None = None, residence: str | None = None) -> DataFrame:
    """``month, province, market, power_class, residence, daytype, hour, kwh`` of a province, and of a market and a residence where they are given."""
    df = sheet(spark, path)
    kwh = next(c for c in df.columns if c.startswith("Prelievo medio"))
    got = df.select(
        cleaning.reference_month(F.col("Anno Mese")).alias("month"), F.col("Provincia").alias("province"), F.col("Tipo mercato").alias("market"), F.col("Classe_potenza").alias("power_class"),
        F.col("Residenza").alias("residence"), F.col("Working Day").alias("daytype"), cleaning.reference_hour(F.col("Orario")).alias("hour"), cleaning.decimal_comma(F.col(kwh)).alias("kwh"),
    ).where(F.col("province") == province)
    for column, wanted in (("market", market), ("residence", residence)):
        got = got if wanted is None else got.where(F.col(column) == wanted)
    return got


def for_power_class(spark: SparkSession, folder: str, label: str, province: str = "Trento") -> DataFrame:
    """The hourly reference of the file that belongs to a class of power."""
    mark = POWER_CLASS_FILES[label]
    name = next(e.name for e in files.entries(folder) if e.name.endswith(".xlsx") and mark in e.name)
    return provincial(spark, f"{folder}/{name}", province)
