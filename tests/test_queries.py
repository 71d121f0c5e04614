"""Every query beside its SQL in DuckDB, at the smallest scale; the analyses end to end on a made-up folder."""

import datetime
import math
import os
import random
import subprocess
import sys
import zipfile

import pytest
from pyspark.sql import functions as F

from loadloom.operators import comparison
from loadloom.plans import cluster_queries, registry
from loadloom.sources import xlsx
from loadloom.streaming import hourly

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "as_tuple") or isinstance(v, float):
        return f"{float(v) + 0:.9g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ENTRIES))
def test_query(spark, duck, name):
    query, sql = registry.ENTRIES[name]
    df = query(spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    if sql:
        want = duck.sql(sql)
        assert sorted(want.columns) == names
        assert got == sorted(tuple(plain(dict(zip(want.columns, r))[c]) for c in names) for r in want.fetchall())


@pytest.mark.parametrize("points", [cluster_queries._profiles, cluster_queries._months])
def test_points_are_shuffled_once(spark, points):
    """One dealing by user serves every grouping on the way to the points."""
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    plan = points(spark, SF)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name, sql", [("monthly_recluster", cluster_queries.MONTHLY_SQL), ("k_per_group", cluster_queries.K_SQL)])
def test_query_with_slow_sql(spark, duck, name, sql):
    df = registry.ENTRIES[name][0](spark, SF)
    want = duck.sql(sql)
    names = sorted(df.columns)
    assert sorted(want.columns) == names
    assert sorted(tuple(plain(r[c]) for c in names) for r in df.collect()) == sorted(tuple(plain(dict(zip(want.columns, r))[c]) for c in names) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    if os.path.isdir(SF):
        assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stream(spark, tmp_path):
    rows = [(k, datetime.datetime(2024, 1, d, h), 1.0) for k in (1, 2) for d in range(1, 5) for h in range(24)]
    df = spark.createDataFrame(rows, "key long, ts timestamp_ntz, value double")
    df.write.parquet(f"{tmp_path}/in")
    stream = hourly.readings(spark, f"{tmp_path}/in", "key long, ts timestamp_ntz, value double")
    query = hourly.run_once(hourly.hourly_totals(stream, "key", "ts", "value"), f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination(60)
    out = spark.read.parquet(f"{tmp_path}/out")
    whole = hourly.hourly_totals(df, "key", "ts", "value")
    assert 0 < out.count() <= whole.count() and out.join(whole, ["key", "start", "total", "n"], "left_anti").count() == 0


def test_code_comparison(spark):
    rng = random.Random(0)
    rows = [(k, datetime.datetime(2024, m, d, h), rng.random() + h) for k in range(6) for m in (1, 2) for d in (1, 2) for h in range(24)]
    df = spark.createDataFrame(rows, "pod long, ts timestamp_ntz, value double")
    dim = spark.createDataFrame([(k, "DO" if k < 3 else "IL" if k == 5 else "A", f"x{k % 2}", "N/A") for k in range(6)], "pod long, l1 string, l2 string, l3 string")
    ref = spark.createDataFrame([(m, h, *[0.2 * h + i for i in range(4)]) for m in (1, 2) for h in range(24)], "month int, hour int, PDMM double, PDMF double, PAUM double, PAUF double")
    monthly, ranking = comparison.code_comparison(df, dim, ref, "pod")
    got = ranking.orderBy("rank").collect()
    assert [r.rank for r in got] == list(range(1, len(got) + 1)) and {r.grp for r in got} == {"1/DO", "1/A", "2/x0", "2/x1"}
    assert monthly.count() == 4 * 2 * 2 and comparison.monthly_quality(monthly).count() == 8
    shares = comparison.group_shares(df, dim.withColumn("grp", F.col("l1")), "pod", "grp")
    one = shares.where("grp = 'A' and month = 1").agg(F.sum("pct")).first()[0]
    assert one * 2 == pytest.approx(100)


def test_command_line(tmp_path):
    root = tmp_path / "data"
    rng = random.Random(1)
    for m, name in enumerate(("gen25", "feb25"), 1):
        d = root / name
        d.mkdir(parents=True)
        pods = [f"IT{i:02d}" for i in range(12)]
        (d / f"Metadati POD {name}.xlsx").write_bytes(xlsx.write({"s": (["POD", "D_49DES", "FDESC", "TATE3DES", "CCATETE"], [[p, "USO", *(("ALTRO", "T", "47.1") if i % 3 else ("USI DOMESTICI NON RESID." if i % 2 else "USI DOMESTICI", "TD", "DO")) ] for i, p in enumerate(pods)])}))
        head = "POD;DataMisura;Tipologia;PotenzaContrattuale;" + ";".join(f"Q{i}" for i in range(1, 97))
        lines = [f"{p};{day:02d}/{m:02d}/2025;AP;2,0;" + ";".join(f"{rng.random() + (q % 7):.2f}".replace(".", ",") for q in range(96)) for p in pods for day in (1, 2)]
        (d / "misure_x.csv").write_text("\n".join([head, *lines]), encoding="utf-8")
    days = [["2025", str(m), "1", str(h), *(f"{x + h / 10:.2f}".replace(".", ",") for x in range(4))] for m in (1, 2) for h in range(24)]
    (tmp_path / "national.xlsx").write_bytes(xlsx.write({"s": (["Anno", "Mese", "Giorno", "Ora", "PDMM", "PDMF", "PAUM", "PAUF"], days)}))
    hours = [["2025-01-01", "Trento", "Tutti", "c", who, day, f"Ora{h}", f"{h / 10}".replace(".", ",")] for who in ("Residente", "Non Residente") for day in ("Giorno feriale", "Sabato") for h in range(1, 25)]
    provincial = tmp_path / "provincial"
    provincial.mkdir()
    (provincial / "ore 1_5_a_3.xlsx").write_bytes(xlsx.write({"s": (["Anno Mese", "Provincia", "Tipo mercato", "Classe_potenza", "Residenza ", "Working Day", "Orario", "Prelievo medio Orario (kWh)"], hours)}))
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = tmp_path / "out"
    compare = ["--reference", str(tmp_path / "national.xlsx"), "--provincial", str(provincial)]
    for analysis, found, more in (("funnel", ["summary.xlsx"], []), ("outliers", ["outliers.zip"], []), ("compare", ["comparison.zip", "national.zip", "provincial.zip"], compare), ("cluster", ["clustering.zip"], ["--clusters", "3"])):
        subprocess.run([sys.executable, "-m", "loadloom", analysis, str(root), str(out), *more], check=True, cwd=home, timeout=300, env=os.environ | {"PYTHONPATH": home}, capture_output=True)
        assert all(zipfile.is_zipfile(out / f) for f in found) and (out / "run.log").exists()

    def sheet(bundle, name):
        with zipfile.ZipFile(out / f"{bundle}.zip") as z:
            head, rows = xlsx.table(z.read(f"{bundle}.xlsx"), name)
            return [dict(zip(head, r)) for r in rows], z.namelist()

    with zipfile.ZipFile(out / "clustering.zip") as z:
        assert {f"clustering_{x}.xlsx" for x in ("L1", "L2", "L3")} | {"across_levels.xlsx", "issues.txt"} <= set(z.namelist())
        assert xlsx.table(z.read("across_levels.xlsx"), "K_per_Month")[1][0][:2] == ["3", "3"]
    year, _ = sheet("comparison", "Annual_Summary")
    # Two months of 24 hours each are the points of the year here.
    assert {r["points"] for r in year} == {"48"} and {r["code"] for r in year} >= {"DO", "47"} and all(r["rmse_mono"] for r in year)
    national, pages = sheet("national", "Metrics")
    assert {(r["grp"], r["month"], r["pairing"]) for r in national} == {(g, m, p) for g in ("DO.R", "DO.NR", "Other") for m in "12" for p in ("mono", "bands")}
    assert {f"{g}_{m:02d}.html" for g in ("DO.R", "DO.NR", "Other") for m in (1, 2)} <= set(pages)
    energy, _ = sheet("provincial", "Metrics_Energy")
    assert {(r["residence"], r["daytype"], r["month"]) for r in energy} == {(w, "Weekday", "1") for w in ("Residente", "Non Residente")}
