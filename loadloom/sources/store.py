"""Cached tables and report files."""

from __future__ import annotations

import csv
import html
import io
import json
import uuid
import zipfile

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files, folders, xlsx

#: Most rows of a table that goes into a report file; a report is read by people.
MOST_ROWS = 100_000


#: What a version of the cache holds, and the columns of each table.
CACHED = {"meta": folders.META, "meas": folders.MEAS, "power_rows": folders.POWER, "issues": folders.ISSUE}


def _pointer(cache: str) -> tuple[int, dict] | None:
    """Number and content of the newest whole pointer: the version that counts and the files that it was made from."""
    there = files.entries(cache) if files.entry(cache) else []
    for e in sorted((e for e in there if e.name.startswith("current-")), key=lambda e: e.name, reverse=True):
        try:
            return int(e.name[8:-5]), json.loads(files.content(f"{cache}/{e.name}"))
        except ValueError:  # half written
            continue
    return None


def _version(spark: SparkSession, cache: str, name: str) -> dict[str, DataFrame]:
    tables = {n: spark.read.schema(schema).parquet(f"{cache}/{name}/{n}.parquet") for n, schema in CACHED.items()}
    return tables | {"power": folders.last_power(tables["power_rows"])}


def save_cache(tables: dict[str, DataFrame], cache: str, made_from: dict, number: int) -> str:
    """Write a version of the cache, measures by period, and then the pointer that makes it count; what is there stays until that, and one version longer."""
    name = f"v{number:08d}-{uuid.uuid4().hex[:8]}"
    try:
        for n in CACHED:
            writer = tables[n].write
            (writer.partitionBy("periodo") if n == "meas" else writer).parquet(f"{cache}/{name}/{n}.parquet")
    except Exception:
        files.delete(f"{cache}/{name}")
        raise
    files.save(f"{cache}/current-{number:08d}.json", json.dumps({"version": name, "files": made_from}).encode())
    kept = {name, *(json.loads(files.content(f"{cache}/{e.name}"))["version"] for e in files.entries(cache) if e.name == f"current-{number - 1:08d}.json")}
    for e in files.entries(cache):
        if e.is_folder and e.name not in kept or e.name.startswith("current-") and int(e.name[8:-5]) < number - 1:
            files.delete(f"{cache}/{e.name}")
    return name


def load_cached(spark: SparkSession, root: str, cache: str | None = None) -> dict[str, DataFrame]:
    """The tables of a root folder. Months whose files are as they were when the cache was written come from it, the others are read and a new version is written.

    A version that can't be written leaves the one before in place, and the tables are given as they were read, with a row in ``issues``.
    """
    cache = cache or f"{root}/_cache"
    now, found = folders.inputs(root), _pointer(cache)
    number, before = found if found else (0, {"files": {}})
    if found and before["files"] == now:
        return _version(spark, cache, before["version"])
    same = {p for p in now if before["files"].get(p) == now[p]}
    tables = folders.load(spark, root, only=set(now) - same)
    if same:
        old = _version(spark, cache, before["version"])
        kept = [f for f, period in folders.folders(root) if period in same]
        for n in ("meta", "meas", "power_rows"):
            tables[n] = tables[n].unionByName(old[n].where(F.col("periodo").isin(*same)))
        tables["issues"] = tables["issues"].unionByName(old["issues"].where(F.regexp_replace("folder", "^.*/", "").isin(*[f.rpartition("/")[2] for f in kept])))
        tables["power"] = folders.last_power(tables["power_rows"])
    try:
        return _version(spark, cache, save_cache(tables, cache, now, number + 1))
    except Exception as e:
        issue = spark.createDataFrame([(cache, "cache", (str(e).splitlines() or [""])[0][:300])], folders.ISSUE)
        return tables | {"issues": tables["issues"].unionByName(issue)}


def drop_cache(root: str, cache: str | None = None) -> None:
    files.delete(cache or f"{root}/_cache")


def reload(spark: SparkSession, root: str, held: dict[str, DataFrame] | None = None, cache: str | None = None) -> dict[str, DataFrame]:
    """The tables of a root folder anew: what Spark keeps of ``held`` and the cache on disk go first."""
    for df in (held or {}).values():
        df.unpersist()
    drop_cache(root, cache)
    return load_cached(spark, root, cache)


def small(df: DataFrame | tuple) -> tuple[list[str], list[tuple]]:
    """Header and rows of a report table, which may be given as such; one that is too large for a report raises :class:`TooLarge`."""
    if isinstance(df, tuple):
        return df
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise TooLarge(f"a report table has over {MOST_ROWS} rows; give a folder for large tables")
    return df.columns, [tuple(r) for r in rows]


class TooLarge(ValueError):
    """A table that doesn't fit a report file."""


def csv_bytes(df: DataFrame, sep: str = ";") -> bytes:
    """UTF-8 with a byte order mark."""
    header, rows = small(df)
    out = io.StringIO()
    w = csv.writer(out, delimiter=sep, lineterminator="\n")
    w.writerow(header)
    w.writerows(rows)
    return out.getvalue().encode("utf-8-sig")


def workbook(tables: dict[str, DataFrame], large: str | None = None) -> bytes:
    """A sheet for each table. One whose columns don't fit the data has the reason in its sheet; anything else that fails, a lost executor say, raises. A table of over MOST_ROWS rows is written
    by Spark, whole, as Parquet under ``large``, and its sheet says where; without such a folder it raises.
    """
    sheets = {}
    for name, df in tables.items():
        try:
            sheets[name] = small(df)
        except TooLarge:
            if large is None:
                raise
            df.write.mode("overwrite").parquet(f"{large}/{name}.parquet")
            sheets[name] = (["Table"], [[f"{large}/{name}.parquet"]])
        except AnalysisException as e:
            sheets[name] = (["Note"], [[str(e).splitlines()[0]]])
    return xlsx.write(sheets)


def html_table(df: DataFrame, title: str = "") -> str:
    header, rows = small(df)
    cell = lambda v: "" if v is None else html.escape(str(v))
    head = "".join(f"<th>{cell(h)}</th>" for h in header)
    body = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in rows)
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table></body></html>'


def save_table(df: DataFrame, folder: str, name: str) -> None:
    """A table as CSV and as workbook."""
    for ending, data in ((".csv", csv_bytes(df)), (".xlsx", workbook({name: df}))):
        files.save(f"{folder}/{name}{ending}", data)


def bundle(workbooks: dict[str, dict[str, DataFrame]], pages: dict[str, DataFrame] | None = None, texts: dict[str, str] | None = None, large: str | None = None) -> bytes:
    """A zip of workbooks (tables by sheet), pages (a table each) and texts; tables too large for it go to the folder ``large``."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, tables in workbooks.items():
            z.writestr(f"{name}.xlsx", workbook(tables, large and f"{large}/{name}"))
        for name, df in (pages or {}).items():
            z.writestr(f"{name}.html", html_table(df, name))
        for name, text in (texts or {}).items():
            z.writestr(name, text)
    return out.getvalue()


def results_folders(root: str) -> tuple[str, str]:
    """The folders of tables and charts of a run."""
    made = tuple(f"{root}/results/{n}" for n in ("tabelle", "grafici"))
    for p in made:
        files.make_folder(p)
    return made
