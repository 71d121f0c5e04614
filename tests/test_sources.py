"""Folders, workbooks, caches and reports."""

import os
import shutil
import zipfile
from io import BytesIO

import pytest

from loadloom.sources import files, folders, references, reports, store, xlsx


def make_root(tmp_path):
    for name, day in (("gen25", "01/02/2025"), ("Feb25", "03/02/2025")):
        d = tmp_path / name
        d.mkdir()
        (d / f"Metadati POD {name}.xlsx").write_bytes(xlsx.write({"s": (["Codice POD", "FDESC", "CCATETE"], [[" it1.0 ", "USI DOMESTICI", "DO.01"], [None, "x", "y"]])}))
        (d / "misure_a.csv").write_text(f"POD;DataMisura;Tipologia;Q1;Q2;Potenza Contrattuale\nit1;{day};ap;1,5;x;3,0\n;{day};ap;1;1;1\n", encoding="utf-8")
    (tmp_path / "mar25").mkdir()
    (tmp_path / "other").mkdir()
    return str(tmp_path)


def test_load(spark, tmp_path):
    root = make_root(tmp_path)
    assert [p for _, p in folders.folders(root)] == ["2025-01", "2025-02", "2025-03"]
    got = folders.load(spark, root)
    meas = sorted(got["meas"].collect(), key=lambda r: r.periodo)
    assert [(r.pod, str(r.date), r.tipologia, r.periodo, r.q[0], r.q[1], len(r.q)) for r in meas] == [("IT1", "2025-02-01", "AP", "2025-01", 1.5, None, 96), ("IT1", "2025-02-03", "AP", "2025-02", 1.5, None, 96)]
    assert got["meta"].count() == 2 and got["power"].collect()[0].potcontr_kw == 3.0 and got["issues"].count() == 2
    assert folders.input_size(root) > 0


def periods(tables):
    return sorted({r.periodo for r in tables["meas"].select("periodo").collect()})


def test_cache(spark, tmp_path, monkeypatch):
    """Only changed months are read; a removed one goes; a write that fails leaves what was there."""
    root = make_root(tmp_path)
    asked, plain = [], folders.load
    monkeypatch.setattr(folders, "load", lambda spark, root, only=None: asked.append(sorted(only)) or plain(spark, root, only))
    first = store.load_cached(spark, root)
    assert first["meas"].count() == 2 and first["issues"].count() == 2 and first["power"].collect()[0].potcontr_kw == 3.0
    assert store.load_cached(spark, root)["meas"].count() == 2 and asked == [["2025-01", "2025-02", "2025-03"]]
    (tmp_path / "Feb25" / "misure_a.csv").write_text("POD;DataMisura;Q1;Potenza Contrattuale\nit1;03/02/2025;2;4,5\nit2;03/02/2025;2;1\n", encoding="utf-8")
    second = store.load_cached(spark, root)
    assert asked[1:] == [["2025-02"]] and second["meas"].count() == 3 and second["meta"].count() == 2 and second["issues"].count() == 2
    assert {r.pod: r.potcontr_kw for r in second["power"].collect()} == {"IT1": 4.5, "IT2": 1.0}
    # Tables of the version before can still be read.
    assert first["meas"].count() == 2
    (tmp_path / "mar25" / "misure_a.csv").write_text("POD;DataMisura;Q1\nit3;03/03/2025;7\n", encoding="utf-8")
    with monkeypatch.context() as m:
        m.setattr(files, "save", lambda path, data: (_ for _ in ()).throw(OSError("disk full")))
        third = store.load_cached(spark, root)
        assert periods(third) == ["2025-01", "2025-02", "2025-03"] and [r.issue for r in third["issues"].where("kind = 'cache'").collect()] == ["disk full"]
    assert periods(second) == ["2025-01", "2025-02"]
    (tmp_path / "_cache" / "current-00000009.json").write_text('{"version": "v0')
    assert periods(store.load_cached(spark, root)) == ["2025-01", "2025-02", "2025-03"] and asked[3:] == [["2025-03"]]
    shutil.rmtree(tmp_path / "gen25")
    assert periods(store.load_cached(spark, root)) == ["2025-02", "2025-03"] and asked[4:] == [[]]
    store.drop_cache(root)
    assert not os.path.exists(os.path.join(root, "_cache"))


def test_workbooks():
    data = xlsx.write({"a/b": (["x", "y"], [[1, "é<&"], [None, 2.5]]), "A_b": (["z"], []), "none": ([], [])})
    assert xlsx.table(data, 0) == (["x", "y"], [["1", "é<&"], [None, "2.5"]]) and xlsx.table(data, "A_b_2") == (["z"], [])
    assert xlsx.table(xlsx.write({}))[0] == ["Note"]
    assert folders.folder_month("gen25") == ("gen", 1, 2025) and folders.folder_month("xyz25") is None


def test_references(spark, tmp_path):
    (tmp_path / "c.xlsx").write_bytes(xlsx.write({"i": (["n"], [[1]]), "c": (["CODICE_ATECO_2025", "TITOLO_ITALIANO_ATECO_2025"], [["47", "trade"], ["nan", "x"], ["DO", "own"]])}))
    codes = {r.code: r.title for r in references.classification(spark, str(tmp_path / "c.xlsx")).collect()}
    assert codes["47"] == "trade" and codes["DO"] == "own" and "DO.R" in codes and "nan" not in codes
    (tmp_path / "g.xlsx").write_bytes(xlsx.write({"g": (["Anno", "Mese ", "Giorno", "Ora", "PDMM"], [["2025", "1", "1", "0", "0,5%"], ["2025", None, "1", "1", "1%"]])}))
    assert [(r.mese, r.ora, r.PDMM) for r in references.national(spark, str(tmp_path / "g.xlsx")).collect()] == [(1, 0, 0.5)]
    head = ["Anno Mese", "Provincia", "Tipo mercato", "Classe_potenza", "Residenza ", "Working Day", "Orario", "Prelievo medio Orario Provinciale (kWh)"]
    rows = [["2024-03-01", "Trento", "Tutti", "c", "Residente", "Sabato", "Ora1", "0,25"], ["anno", "Trento", "Tutti", "c", "Residente", "Sabato", "Ora24", "1"], ["2024-03-01", "Roma", "Tutti", "c", "Residente", "Sabato", "Ora1", "9"]]
    (tmp_path / "dati potenza6 x.xlsx").write_bytes(xlsx.write({"a": (head, rows)}))
    got = references.for_power_class(spark, str(tmp_path), "> 6 kW").collect()
    assert [(r.month, r.hour, r.kwh) for r in got] == [(3, 0, 0.25), (0, 23, 1.0)]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a;b"), (2, None)], "n int, t string")
    assert store.csv_bytes(df).startswith(b"\xef\xbb\xbfn;t\n") and b'"a;b"' in store.csv_bytes(df)
    store.save_table(df, str(tmp_path), "x")
    assert {"x.csv", "x.xlsx"} <= set(os.listdir(tmp_path))
    with zipfile.ZipFile(BytesIO(store.bundle({"w": {"s": df}}, {"p": df}, {"issues.txt": "none"}))) as z:
        assert sorted(z.namelist()) == ["issues.txt", "p.html", "w.xlsx"] and "<td>a;b</td>" in z.read("p.html").decode()
    assert all(os.path.isdir(p) for p in store.results_folders(str(tmp_path)))


def test_large_tables(spark, tmp_path, monkeypatch):
    """A table that a workbook can't hold is written whole, or raises; no sheet lacks rows in silence."""
    monkeypatch.setattr(store, "MOST_ROWS", 10)
    df, ok = spark.range(25), spark.range(3)
    with pytest.raises(store.TooLarge):
        store.bundle({"w": {"s": df}})
    data = store.workbook({"s": df, "t": ok}, str(tmp_path / "tables"))
    assert spark.read.parquet(f"{tmp_path}/tables/s.parquet").count() == 25
    assert xlsx.table(data, "s") == (["Table"], [[f"{tmp_path}/tables/s.parquet"]]) and len(xlsx.table(data, "t")[1]) == 3


def test_clustering_bundle(spark):
    dim = spark.createDataFrame([(f"p{i}", f"{i % 2}", f"{i % 2}.{i % 3}") for i in range(12)], "pod string, l1 string, l2 string")
    pods = dim.selectExpr("pod", "cast(substr(pod, 2) as int) % 3 as cluster")
    long = pods.selectExpr("pod as key", "cluster", "explode(sequence(0, 3)) as slot").selectExpr("*", "cast(slot * (cluster + 1) as double) + length(key) as v")
    with zipfile.ZipFile(BytesIO(reports.clustering_bundle(pods, long, dim, "l2"))) as z:
        assert {"clustering.xlsx", "ateco_breakdown.html", "cluster_breakdown.html", "statistics.html"} <= set(z.namelist())
        book = z.read("clustering.xlsx")
    names = "Cluster_Stats Global_Metrics Pearson_Corr Pearson_PValues POD_List Cluster_Composition Composition_by_L1 Composition_by_L2 Profiles_with_Cluster All_Centroids ATECO_Dominant_Cluster ATECO_Breakdown Cluster_ATECO_Breakdown Breakdown_by_L1 Breakdown_by_L2"
    for name in names.split():
        head, rows = xlsx.table(book, name)
        assert head != ["Note"] and rows, name


def test_comparison_bundles(spark):
    metrics = spark.createDataFrame([("g", 1, "mono", 0.9, 4.0, 3.0), ("g", 2, "mono", 0.8, 6.0, 5.0)], "grp string, month int, pairing string, r double, rmse double, mae double")
    ranking = metrics.groupBy("grp").avg("rmse")
    annual = spark.createDataFrame([("g", 288, 4.5)], "grp string, points int, rmse double")
    with zipfile.ZipFile(BytesIO(reports.comparison_bundle(metrics, metrics, ranking, annual))) as z:
        assert xlsx.table(z.read("comparison.xlsx"), "Annual_Summary")[1] == [["g", "288", "4.5"]]
    with zipfile.ZipFile(BytesIO(reports.comparison_bundle(metrics, metrics))) as z, pytest.raises(KeyError):
        xlsx.table(z.read("comparison.xlsx"), "Annual_Summary")
    with zipfile.ZipFile(BytesIO(reports.provincial_bundle(metrics, metrics, metrics))) as z:
        assert len(xlsx.table(z.read("provincial.xlsx"), "Profile_Data_kWh")[1]) == 2


def test_reload(spark, tmp_path):
    root = make_root(tmp_path)
    held = store.load_cached(spark, root)
    (tmp_path / "feb25extra").mkdir()
    got = store.reload(spark, root, held)
    assert got["meas"].count() == 2 and os.path.exists(os.path.join(root, "_cache"))


def test_older_and_national_bundles(spark):
    pods = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "pod string, cluster int")
    long = pods.selectExpr("pod as key", "cluster", "explode(sequence(0, 3)) as slot").selectExpr("*", "cast(slot as double) as v")
    with zipfile.ZipFile(BytesIO(reports.descriptive_bundle(long, pods, long))) as z:
        assert len(xlsx.table(z.read("measures_with_cluster.xlsx"), "Measures")[1]) == 12
        assert all(xlsx.table(z.read("descriptives.xlsx"), n)[0] != ["Note"] for n in ("Summary", "Centroids", "POD_Cluster_List", "Cluster_Sizes"))
    metrics = spark.createDataFrame([("g", 1, "mono", 4.0)], "grp string, month int, pairing string, rmse double")
    profile = spark.createDataFrame([("g", m, h, 1.0) for m in (1, 2) for h in range(24)], "grp string, month int, hour int, pct double")
    with zipfile.ZipFile(BytesIO(reports.national_bundle(metrics, profile))) as z:
        assert {"overview.html", "g_01.html", "g_02.html", "national.xlsx"} == set(z.namelist())


def test_many_workbooks_in_one_scan(spark, tmp_path):
    """Two years of metadata are parsed by tasks; broken files are rows of the issues table."""
    from loadloom.functions.calendar import MONTHS

    names = [f"{m}{y}" for y in (24, 25) for m in MONTHS]
    for i, name in enumerate(names):
        d = tmp_path / name
        d.mkdir()
        data = b"no workbook" if i == 5 else xlsx.write({"s": (["Codice POD" if i != 7 else "Other", "FDESC"], [[f" p{i}_{k} ", "x"] for k in range(30)] + [[None, "y"]])})
        (d / f"Metadati POD {name}.xlsx").write_bytes(data)
    got = folders.load(spark, str(tmp_path))
    rows = got["meta"].groupBy("periodo").count().collect()
    assert len(rows) == 22 and {r["count"] for r in rows} == {30}
    wrong = {(r.folder.rpartition("/")[2], r.kind) for r in got["issues"].collect() if r.issue != "not found"}
    assert wrong == {(names[5], "metadata"), (names[7], "metadata")}
    first = got["meta"].where("periodo = '2024-01'").orderBy("row_ord").first()
    assert first.pod == "P0_0" and first.row_ord == 0


def test_failures_are_not_notes(spark):
    """What breaks in a task raises; a column that isn't there is a note in its sheet."""
    class Missing:
        def limit(self, n):
            return spark.range(1).select("nothing")

    assert xlsx.table(store.workbook({"s": Missing()}), "s")[0] == ["Note"]
    broken = spark.range(3).selectExpr("raise_error('lost')")
    with pytest.raises(Exception, match="lost"):
        store.workbook({"s": broken})


def test_levels_bundle(spark):
    """Three levels, square matrices, the row of k, and the matrix across levels."""
    dim = spark.createDataFrame([(f"p{i}", f"{i % 2}", f"{i % 2}.{i % 3}", f"{i % 2}.{i % 3}.1") for i in range(24)], "pod string, l1 string, l2 string, l3 string")
    levels = {}
    for level, n in (("l1", 2), ("l2", 3), ("l3", 4)):
        pods = dim.selectExpr("pod", f"concat('{level}-', cast(substr(pod, 2) as int) % {n}) as cluster")
        levels[level] = pods, pods.selectExpr("pod as key", "cluster", "explode(sequence(0, 5)) as slot").selectExpr("*", "sin(slot * (cast(substr(cluster, 4) as int) + 1) + length(key)) as v")
    monthly = spark.createDataFrame([(1, 3), (2, 5)], "month int, k int")
    with zipfile.ZipFile(BytesIO(reports.levels_bundle(levels, dim, monthly))) as z:
        names = {f"clustering_{x}.xlsx" for x in ("L1", "L2", "L3")} | {"across_levels.xlsx"} | {f"{x}_{p}.html" for x in levels for p in ("ateco_breakdown", "cluster_breakdown", "statistics")}
        assert names == set(z.namelist())
        for level, n in (("L1", 2), ("L2", 3), ("L3", 4)):
            book = z.read(f"clustering_{level}.xlsx")
            for sheet, diagonal in (("Pearson_Corr", 1.0), ("Pearson_PValues", 0.0)):
                head, rows = xlsx.table(book, sheet)
                assert head == ["name", *(f"{level.lower()}-{i}" for i in range(n))] and [r[0] for r in rows] == head[1:]
                m = [[float(v) for v in r[1:]] for r in rows]
                assert all(m[i][i] == diagonal and m[i][j] == m[j][i] for i in range(n) for j in range(n))
            assert xlsx.table(book, "Cluster_Stats")[0] != ["Note"] and len(xlsx.table(book, "Cluster_Stats")[1]) == n
        across = z.read("across_levels.xlsx")
        head, rows = xlsx.table(across, "Cross_Level_Pearson")
        assert len(rows) == 9 and len(head) == 10 and all(float(r[1 + i]) == 1.0 for i, r in enumerate(rows))
        assert len(xlsx.table(across, "Clusters_by_Level")[1]) == 24
        head, rows = xlsx.table(across, "K_per_Month")
        assert head == [str(m) for m in range(1, 13)] and rows[0][:3] == ["3", "5", None]
