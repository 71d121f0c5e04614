"""Edges of bins, bands, codes and typed texts."""

import datetime

import pytest
from pyspark.sql import functions as F

from loadloom.functions import arrays, binning, calendar, cleaning, taxonomy, text


def one(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_cleaning(spark):
    keys = [(" it001.0 ",), (None,), ("nan",), ("",)]
    got = one(spark, keys, "k string", cleaning.normalize_key(F.col("k")), cleaning.is_valid_key(cleaning.normalize_key(F.col("k"))))
    assert got == [("IT001", True), (None, False), ("NAN", False), ("", False)]
    assert one(spark, [("1,5",), ("1.234,5",), ("x",), (None,)], "v string", cleaning.decimal_comma(F.col("v"))) == [(1.5,), (None,), (None,), (None,)]
    assert one(spark, [("01/02/2025",), ("bad",)], "d string", cleaning.day_first(F.col("d"))) == [(datetime.date(2025, 2, 1),), (None,)]
    assert one(spark, [("Ora1",), ("Ora24",), ("x",)], "h string", cleaning.reference_hour(F.col("h"))) == [(0,), (23,), (None,)]
    assert one(spark, [("2024-03-01",), ("2024",), ("anno",)], "m string", cleaning.reference_month(F.col("m")))[0] == (3,)


def test_percent_column(spark):
    marked = spark.createDataFrame([("0,10%",), ("5",)], "p string")
    assert [r.v for r in cleaning.percent_column(marked, "p", "v").collect()] == [0.1, 5.0]
    plain = spark.createDataFrame([("0.001",), (None,)], "p string")
    assert [r.v for r in cleaning.percent_column(plain, "p", "v").collect()] == [pytest.approx(0.1), None]


def test_resolvers():
    assert cleaning.resolve_column(["x", " pod "], cleaning.META_SPELLINGS["POD"]) == " pod "
    assert cleaning.resolve_power_column(["a", "MAX_POT_CONTR_KW"]) == "MAX_POT_CONTR_KW"
    assert cleaning.resolve_power_column(["a", "potenza x"]) == "potenza x" and cleaning.resolve_power_column(["a"]) is None
    assert cleaning.resolve_kind_column(["TIPOLOGIA"]) == "TIPOLOGIA"


def test_bins(spark):
    v = F.col("v")
    c = binning.label(binning.right_closed(v, binning.COMPLETENESS_EDGES), binning.COMPLETENESS_LABELS)
    assert [r[0] for r in one(spark, [(0.0,), (50.0,), (100.0,)], "v double", c)] == [None, "<50%", ">=99.9%"]
    m = binning.label(binning.left_closed(v, binning.MONTH_EDGES), binning.MONTH_LABELS)
    assert [r[0] for r in one(spark, [(0.0,), (12.0,), (18.0,), (19.0,), (100.0,)], "v double", m)] == ["<1", "12-14", "15-18", "19+", None]
    p = binning.label(binning.right_closed(v, binning.POWER_EDGES), binning.POWER_LABELS)
    assert [r[0] for r in one(spark, [(0.0,), (1.0,), (1.5,), (110.0,), (110.1,)], "v double", p)] == [None, "≤1 kW", "1–1.5 kW", "55–110 kW", ">110 kW"]
    q = [r[0] for r in one(spark, [(4.999,), (5.0,), (10.0,), (20.0,), (None,)], "v double", binning.quality(v))]
    assert q == ["Good", "Acceptable", "Not Comparable", "Very Different", "—"]
    assert [r[0] for r in one(spark, [(None,), (1.5,), (6.5,)], "v double", binning.power_class(v))] == [None, "≤ 1.5 kW", "> 6 kW"]


def test_bands(spark):
    rows = [(0, 7), (0, 8), (0, 18), (0, 19), (0, 22), (0, 23), (5, 6), (5, 7), (5, 22), (5, 23), (6, 12)]
    got = [r[0] for r in one(spark, rows, "d int, h int", calendar.band(F.col("d"), F.col("h")))]
    assert got == ["F2", "F1", "F1", "F2", "F2", "F3", "F3", "F2", "F2", "F3", "F3"]
    assert one(spark, [(1,), (96,)], "s int", calendar.slot_label(F.col("s"))) == [("00:00",), ("23:45",)]


def test_taxonomy(spark):
    codes = [("47.11.10",), ("DO.01",), ("A",), ("",), ("A.",), (None,)]
    got = [tuple(r)[1:] for r in taxonomy.levels(spark.createDataFrame(codes, "c string"), "c").collect()]
    assert got == [("47", "47.11", "47.11.10"), ("DO", "DO.01", None), ("A", None, None), (None, None, None), ("A", None, None), (None, None, None)]
    domestic = [r[0] for r in one(spark, [("USI NON RESID.",), ("USO DOMESTICO",), ("RESIDENTE",), ("altro",)], "t string", taxonomy.domestic(F.col("t")))]
    assert domestic == ["DO.NR", "DO.R", "DO.R", None]
    titles = spark.createDataFrame([("47", "trade"), ("47.1", "shops")], "code string, title string")
    df = spark.createDataFrame([("47.1.9",), ("47.2",), ("99",), (None,)], "c string")
    assert {r.c: r.description for r in taxonomy.describe(df, "c", titles).collect()} == {"47.1.9": "shops", "47.2": "trade", "99": "", None: ""}
    assert taxonomy.with_distributors(titles.limit(1)).count() == 1 + len(taxonomy.DISTRIBUTOR_CODES)


def test_text_and_arrays(spark):
    q = spark.createDataFrame([([1.0, None, 3.0, 0.0],), ([None, None, None, None],), ([2.0, 2.0, 2.0, 2.0],)], "q array<double>")
    got = [tuple(r) for r in q.select(arrays.total(F.col("q")), arrays.nulls(F.col("q")), arrays.minmax(F.col("q")), arrays.any_nonzero(F.col("q"))).collect()]
    assert got[0] == (4.0, 1, [pytest.approx(1 / 3), None, 1.0, 0.0], True) and got[1][:2] == (0.0, 4) and got[2][2] == [0.0] * 4
    assert one(spark, [(1, 3)], "n int, t int", text.count_and_percent(F.col("n"), F.col("t"))) == [("1 (33.3%)",)]
    assert one(spark, [("a", None)], "a string, b string", text.typology_label(F.col("a"), F.col("b"))) == [(None,)]


def test_levels_with_empty_parts(spark):
    rows = [("47..10",), (".5",), ("47.11",)]
    df = taxonomy.levels(spark.createDataFrame(rows, "c string"), "c")
    assert [tuple(r)[1:] for r in df.collect()] == [("47", None, "47..10"), (None, ".5", None), ("47", "47.11", None)]


def test_distinct_in_order(spark):
    df = spark.createDataFrame([("g", "b", 1), ("g", "a", 2), ("g", "b", 3), ("h", "a", 4)], "k string, v string, i int")
    assert {r.k: r.v for r in text.distinct_in_order(df, ["k"], "v", "i").collect()} == {"g": ["b", "a"], "h": ["a"]}
