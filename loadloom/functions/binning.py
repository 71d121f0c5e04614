"""Bins with named edges, and grades."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
#: Edges of bins.
MONTH_EDGES = [0, 1, 3, 6, 9, 12, 15, 19, 100]
MONTH_LABELS = ["<1", "1-2", "3-5", "6-8", "9-11", "12-14", "15-18", "19+"]
ANNUAL_EDGES = [0, 500, 1000, 1500, 2000, 3000, 5000, 10000, 20000, 50000, 100000, INF]
COMPLETENESS_EDGES = [0, 50, 80, 90, 95, 99, 99.9, 100.01]
COMPLETENESS_LABELS = ["<50%", "50-80%", "80-90%", "90-95%", "95-99%", "99-99.9%", ">=99.9%"]
POWER_EDGES = [0, 1, 1.5, 2, 3, 6, 10, 16.5, 33, 55, 110, INF]
POWER_LABELS = ["≤1 kW", "1–1.5 kW", "1.5–2 kW", "2–3 kW", "3–6 kW", "6–10 kW", "10–16.5 kW", "16.5–33 kW", "33–55 kW", "55–110 kW", ">110 kW"]
#: Classes of the reference tables: label and interval, open below and closed above.
POWER_CLASSES = [("≤ 1.5 kW", 0, 1.5), ("1.5–3 kW", 1.5, 3), ("3–4.5 kW", 3, 4.5), ("4.5–6 kW", 4.5, 6), ("> 6 kW", 6, INF)]


def left_closed(v: Column, edges: list[float]) -> Column:
    """The number of the bin [edge, next edge), null outside."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        inside = v >= edges[i] if edges[i + 1] == INF else (v >= edges[i]) & (v < edges[i + 1])
        out = F.when(inside, F.lit(i)).otherwise(out)
    return out


def right_closed(v: Column, edges: list[float]) -> Column:
    """The number of the bin (edge, next edge], null outside."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        inside = v > edges[i] if edges[i + 1] == INF else (v > edges[i]) & (v <= edges[i + 1])
        out = F.when(inside, F.lit(i)).otherwise(out)
    return out


def label(number: Column, labels: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, labels)), number)


def annual_labels() -> list[str]:
    e = ANNUAL_EDGES
    return [f"{e[i]}-{e[i + 1]}" if e[i + 1] != INF else f"{e[i]}+" for i in range(len(e) - 1)]


def power_class(v: Column) -> Column:
    """The class of a power; null counts as 0 and so has none."""
    out = F.lit(None).cast("string")
    v = F.coalesce(v, F.lit(0))
    for name, lo, hi in POWER_CLASSES:
        out = F.when((v > lo) & (v <= hi) if hi != INF else v > lo, F.lit(name)).otherwise(out)
    return out


def quality(rmse: Column) -> Column:
    good = F.when(rmse < 5, "Good").when(rmse < 10, "Acceptable").when(rmse < 20, "Not Comparable").otherwise("Very Different")
    return F.when(rmse.isNull() | F.isnan(rmse) | (rmse == INF), "—").otherwise(good)


def histogram_bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bins of equal width; the highest value belongs to the last one."""
    at = F.floor(F.try_divide((v - lo) * bins, hi - lo)).cast("int")
    return F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1))
