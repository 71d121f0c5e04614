"""Labels and cells of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths of the parts of a typology label, by their number.
CUTS = {3: (20, 20, 35), 2: (25, 30), 1: (50,)}


def typology_label(*parts: Column) -> Column:
    """The parts cut and joined by bars; null if any is."""
    cut = [F.substring(p, 1, n) for p, n in zip(parts, CUTS[len(parts)], strict=True)]
    return F.concat(*[x for i, c in enumerate(cut) for x in ((F.lit(" | "), c) if i else (c,))])


def usable(c: Column) -> Column:
    return F.when(~F.trim(c).isin("", "N/A", "NAN", "nan"), c)


def code_label(codes: list[Column], descriptions: list[Column], others: list[Column], code_length: int = 45, other_length: int = 55) -> Column:
    """The first usable code with its description cut, else the first usable other text cut, else Unknown."""
    out = F.lit("Unknown")
    for o in reversed(others):
        out = F.when(usable(o).isNotNull(), F.substring(o, 1, other_length)).otherwise(out)
    for c, d in reversed(list(zip(codes, descriptions, strict=True))):
        named = F.when(F.coalesce(d, F.lit("")) != "", F.concat(c, F.lit(" | "), F.substring(d, 1, code_length))).otherwise(c)
        out = F.when(usable(c).isNotNull(), named).otherwise(out)
    return out


def count_and_percent(n: Column, total: Column) -> Column:
    """``n (p%)`` with one place."""
    share = F.round(100.0 * n / total, 1).cast("decimal(5,1)").cast("string")
    return F.concat(n.cast("string"), F.lit(" ("), share, F.lit("%)"))


def thousands(n: Column) -> Column:
    """Thousands parted by narrow no-break spaces."""
    return F.translate(F.format_number(n, 0), ",", " ")


def distinct_in_order(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """By group its distinct values as an array, in the order in which they first come."""
    first = df.groupBy(*by, value).agg(F.min(order).alias("__first"))
    got = first.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__first", F.col(value).alias("__v")))).alias("__all"))
    return got.select(*by, F.transform("__all", lambda x: x["__v"]).alias(value))
