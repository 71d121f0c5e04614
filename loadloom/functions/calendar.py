"""Calendar parts, periods and tariff bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Italian month names of three letters.
MONTHS = {"gen": 1, "feb": 2, "mar": 3, "apr": 4, "mag": 5, "giu": 6, "lug": 7, "ago": 8, "set": 9, "ott": 10, "nov": 11, "dic": 12}
MONTH_LABELS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def weekday(ts: Column) -> Column:
    """0 for Monday to 6 for Sunday."""
    return F.weekday(ts)


def period(ts: Column) -> Column:
    """yyyy-MM."""
    return F.date_format(ts, "yyyy-MM")


def period_number(p: Column) -> Column:
    """``2024-03`` as 202403."""
    return (F.substring(p, 1, 4).cast("int") * 100 + F.substring(p, 6, 2).cast("int")).cast("int")


def period_label(p: Column) -> Column:
    """``2024-03`` as ``Mar 2024``."""
    return F.concat(F.element_at(F.array(*map(F.lit, MONTH_LABELS)), F.substring(p, 6, 2).cast("int")), F.lit(" "), F.substring(p, 1, 4))


def month_index(ts: Column) -> Column:
    """Months since year 0, so that neighbours differ by 1."""
    return F.year(ts) * 12 + F.month(ts) - 1


def day_type(ts: Column) -> Column:
    d = weekday(ts)
    return F.when(d < 5, "Weekday").when(d == 5, "Saturday").otherwise("Sunday")


def band(day: Column, hour: Column) -> Column:
    """The tariff band of a weekday (0 is Monday) and an hour. Holidays count as what day they are."""
    work = F.when(hour.between(8, 18), "F1").when((hour == 7) | hour.between(19, 22), "F2").otherwise("F3")
    saturday = F.when(hour.between(7, 22), "F2").otherwise("F3")
    return F.when(day == 6, "F3").when(day == 5, saturday).otherwise(work)


def slot_label(slot: Column) -> Column:
    """Quarter-hour 1 to 96 as HH:MM."""
    at = (slot - 1).cast("int")
    return F.format_string("%02d:%02d", F.floor(at / 4).cast("int"), F.pmod(at, F.lit(4)) * 15)
