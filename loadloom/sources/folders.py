"""Monthly folders of metadata workbooks and measure files, read into typed tables.

Folders, in any store that Spark reads, are listed on the driver, which knows a handful of them for each year; workbooks are parsed by the tasks of one scan, measure files are read by Spark as
texts, one reader for each delimiter and header, and typed in the plan. What can't be read becomes a row of the issues table.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cleaning
from ..functions.calendar import MONTHS
from ..operators.ranking import held
from . import files, xlsx

SLOTS = 96
META = T.StructType([T.StructField(c, T.StringType()) for c in ("pod", "d49", "fdesc", "tate3", "ccatete", "periodo")] + [T.StructField("row_ord", T.LongType())])

MEAS = "pod string, date date, tipologia string, periodo string, q array<float>, row_ord long"
POWER = "pod string, potcontr_kw double, periodo string, row_ord long"
ISSUE = "folder string, kind string, issue string"


def folder_month(name: str) -> tuple[str, int, int] | None:
    """``gen25`` -> (gen, 1, 2025); None for other names."""
    m = re.fullmatch(r"([a-zA-Z]{3})(\d{2})", name)
    if not m or m[1].lower() not in MONTHS:
        return None
    return m[1].lower(), MONTHS[m[1].lower()], 2000 + int(m[2])


def folders(root: str) -> list[tuple[str, str]]:
    """(path, yyyy-MM) of the monthly folders, in order of time."""
    found = [(folder_month(e.name), e.name) for e in files.entries(root) if e.is_folder]
    return [(f"{root}/{n}", f"{m[2]}-{m[1]:02d}") for m, n in sorted((x for x in found if x[0]), key=lambda x: (x[0][2], x[0][1]))]


def metadata_file(folder: str) -> str | None:
    exact = f"Metadati POD {folder.rstrip('/').rpartition('/')[2]}.xlsx"
    names = [e.name for e in files.entries(folder)]
    pick = [f for f in names if f == exact] or [f for f in names if f.lower().endswith(".xlsx") and "metadati" in f.lower()]
    return f"{folder}/{pick[0]}" if pick else None


def measures_file(folder: str) -> str | None:
    names = [e.name for e in files.entries(folder) if e.name.lower().endswith(".csv")]
    pick = [f for f in names if f.lower().startswith("misure_")] or [f for f in names if "misure" in f.lower()]
    return f"{folder}/{pick[0]}" if pick else None


def delimiter(path: str) -> str:
    """By the first line: what csv's sniffer says, else the most frequent of the usual ones."""
    line = files.first_line(path)
    try:
        return csv.Sniffer().sniff(line, delimiters=";,\t|").delimiter
    except csv.Error:
        return max(";,\t|", key=line.count)


def _sheet_rows(periods: dict[str, str]):
    """Workbooks -> rows of their metadata, or one row with what is wrong with the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                period = periods["/".join(unquote(path).split("/")[-2:])]
                try:
                    header, rows = xlsx.table(data)
                    at = [cleaning.resolve_column(header, s) for s in cleaning.META_SPELLINGS.values()]
                    if at[0] is None:
                        raise ValueError("no POD column")
                    where = [header.index(c) if c else None for c in at]
                    columns = [[None if w is None or r[w] is None else str(r[w]) for r in rows] for w in where]
                    wrong = [None] * len(rows)
                except Exception as e:  # a broken file is reported, the others are loaded
                    columns, wrong, rows = [[None]] * len(cleaning.META_SPELLINGS), [(str(e).splitlines() or [type(e).__name__])[0][:300]], [()]
                arrays = [*(pa.array(c, pa.string()) for c in columns), pa.array([period] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64()), pa.array([path] * len(rows), pa.string()), pa.array(wrong, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, [*META.names, "path", "issue"])

    return run


def metadata(spark: SparkSession, periods: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """The rows of the metadata workbooks (path -> period), and ``folder, kind, issue`` of those that can't be read.

    All workbooks are one scan of binary files, a task for each, which parses its file and passes its rows on; none goes through the driver.
    """
    if not periods:
        return spark.createDataFrame([], META), spark.createDataFrame([], ISSUE)
    short = {"/".join(p.split("/")[-2:]): period for p, period in periods.items()}
    found = spark.read.format("binaryFile").load([_escaped(p) for p in periods]).select("path", "content").repartition(len(periods), "path")
    schema = T.StructType([*META.fields, T.StructField("path", T.StringType()), T.StructField("issue", T.StringType())])
    rows = held(found.mapInArrow(_sheet_rows(short), schema))
    good = rows.where("issue is null").drop("path", "issue").withColumn("pod", cleaning.normalize_key(F.col("pod")))
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return good.where(cleaning.is_valid_key(F.col("pod"))), rows.where("issue is not null").select(folder.alias("folder"), F.lit("metadata").alias("kind"), "issue")


def _escaped(path: str) -> str:
    """A path whose signs mean themselves to a reader that takes patterns."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def measures(spark: SparkSession, path: str, period: str) -> tuple[DataFrame, DataFrame | None]:
    """The measures of a file, and the contract power of its rows where it has such a column."""
    raw = spark.read.csv(path, sep=delimiter(path), header=True, inferSchema=False, encoding="UTF-8")
    cols = raw.columns
    pod, date = cleaning.resolve_column(cols, cleaning.META_SPELLINGS["POD"]), cleaning.resolve_column(cols, ["DataMisura", "Data Misura", "DATAMISURA"])
    if pod is None or date is None:
        raise ValueError("no POD or DataMisura column")
    kind, power = cleaning.resolve_kind_column(cols), cleaning.resolve_power_column(cols)
    there = {c.strip().upper(): c for c in cols}
    number = lambda c: F.col(f"`{c}`")
    q = F.array(*[cleaning.decimal_comma(number(there[f"Q{i}"])).cast("float") if f"Q{i}" in there else F.lit(None).cast("float") for i in range(1, SLOTS + 1)])
    keyed = raw.withColumns({"__pod": cleaning.normalize_key(number(pod)), "row_ord": F.monotonically_increasing_id()}).where(cleaning.is_valid_key(F.col("__pod")))
    out = keyed.select(
        F.col("__pod").alias("pod"), cleaning.day_first(number(date)).alias("date"), (F.upper(F.trim(number(kind))) if kind else F.lit(None).cast("string")).alias("tipologia"),
        F.lit(period).alias("periodo"), q.alias("q"), "row_ord",
    )
    side = keyed.select(F.col("__pod").alias("pod"), cleaning.decimal_comma(number(power)).alias("potcontr_kw"), F.lit(period).alias("periodo"), "row_ord").where("potcontr_kw is not null") if power else None
    return out, side


def inputs(root: str) -> dict[str, list[list]]:
    """By period what its folder holds: name, length and time of each file."""
    return {period: [[e.name, e.size, e.modified] for e in files.entries(folder) if not e.is_folder] for folder, period in folders(root)}


def last_power(rows: DataFrame) -> DataFrame:
    """The last contract power of each key, by file, then by row."""
    return rows.groupBy("pod").agg(F.max_by("potcontr_kw", F.struct("periodo", "row_ord")).alias("potcontr_kw"))


def load(spark: SparkSession, root: str, only: set[str] | None = None) -> dict[str, DataFrame]:
    """``meta``, ``meas``, ``power`` (last value of each key), ``power_rows`` and ``issues`` of all monthly folders, or of the periods asked for."""
    meass, powers, issues, books = [], [], [], {}
    for folder, period in folders(root):
        if only is not None and period not in only:
            continue
        for find, kind in ((metadata_file, "metadata"), (measures_file, "measures")):
            path = find(folder)
            if not path:
                issues.append((folder, kind, "not found"))
            elif kind == "metadata":
                books[path] = period
            else:
                try:
                    rows, side = measures(spark, path, period)
                    meass.append(rows)
                    powers += [side] if side is not None else []
                except Exception as e:  # a broken file is reported, the others are loaded
                    issues.append((folder, kind, str(e).splitlines()[0][:300]))
    meta, broken = metadata(spark, books)

    def union(parts: list[DataFrame], schema) -> DataFrame:
        out = parts[0] if parts else spark.createDataFrame([], schema)
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    power = union(powers, POWER)
    return {
        "meta": meta,
        "meas": union(meass, MEAS),
        "power": last_power(power),
        "power_rows": power,
        "issues": spark.createDataFrame(issues, ISSUE).unionByName(broken),
    }


def input_size(root: str, skip: str = "_cache") -> int:
    """Bytes below a folder, without its cache."""
    return sum(input_size(f"{root}/{e.name}", skip) if e.is_folder else e.size for e in files.entries(root) if not (e.is_folder and e.name == skip))
