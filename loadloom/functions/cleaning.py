"""Raw text to typed values. A value that can't be read is null, never an error."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accepted spellings of columns by target name.
META_SPELLINGS = {
    "POD": ["POD", "pod", "Pod", "Codice POD"],
    "D_49DES": ["D_49DES", "d_49des", "D_49_DES", "D49DES"],
    "FDESC": ["FDESC", "fdesc", "F_DESC"],
    "TATE3DES": ["TATE3DES", "tate3des", "TATE3_DES"],
    "CCATETE": ["CCATETE", "ccatete", "Ccatete", "CCATE", "CodiceATECO"],
}
POWER_SPELLINGS = ["PotenzaContrattuale", "Potenza Contrattuale", "Potenza_Contrattuale", "POTCONTR", "POT_CONTR", "POTCON"]
KIND_SPELLINGS = ["Tipologia", "TIPOLOGIA", "tipologia", "Tipo", "TIPO", "tipo"]


def normalize_key(c: Column) -> Column:
    """Trimmed, upper-case, without a trailing ``.0``."""
    return F.regexp_replace(F.upper(F.trim(c.cast("string"))), r"\.0$", "")


def is_valid_key(c: Column) -> Column:
    return c.isNotNull() & ~c.isin("", "NAN")


def decimal_comma(c: Column) -> Column:
    """``1,5`` is 1.5; ``1.234,5`` isn't a number."""
    return F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double")


def day_first(c: Column) -> Column:
    """dd/MM/yyyy as a date."""
    return F.try_to_timestamp(F.trim(c), F.lit("dd/MM/yyyy")).cast("date")


def percent_column(df: DataFrame, column: str, out: str) -> DataFrame:
    """Numbers of a column as percentages: as they are if any value has a %, times 100 otherwise.

    The decision is one row, joined by broadcast.
    """
    number = decimal_comma(F.replace(F.col(column), F.lit("%"), F.lit("")))
    marked = df.agg(F.coalesce(F.max(F.col(column).contains("%")), F.lit(False)).alias("__marked"))
    scaled = F.when(F.col("__marked"), number).otherwise(number * 100)
    return df.join(F.broadcast(marked)).withColumn(out, scaled).drop("__marked")


def reference_month(c: Column) -> Column:
    """The month of a date; whatever isn't one stands for the whole year: 0."""
    return F.coalesce(F.month(F.try_to_timestamp(c.cast("string"))), F.lit(0))


def reference_hour(c: Column) -> Column:
    """``Ora1`` to ``Ora24`` as 0 to 23."""
    return F.replace(c, F.lit("Ora"), F.lit("")).try_cast("int") - 1


def resolve_column(columns: list[str], spellings: list[str]) -> str | None:
    """The first spelling that is there, else one that is alike but for case and blanks around it."""
    for s in spellings:
        if s in columns:
            return s
    alike = {c.strip().lower(): c for c in reversed(columns)}
    return next((alike[s.strip().lower()] for s in spellings if s.strip().lower() in alike), None)


def resolve_power_column(columns: list[str]) -> str | None:
    """Spelling, then spelling without case, then a name with the term in it, then any name with ``potenza``."""
    found = resolve_column(columns, POWER_SPELLINGS)
    if found:
        return found
    bare = {c: re.sub(r"[_ ]", "", c.lower()) for c in columns}
    for c, b in bare.items():
        if "potenzacontrattuale" in b or "potcontr" in b:
            return c
    return next((c for c, b in bare.items() if "potenza" in b), None)


def resolve_kind_column(columns: list[str]) -> str | None:
    return resolve_column(columns, KIND_SPELLINGS)


def sentinel(c: Column, value: str = "N/A") -> Column:
    return F.coalesce(c, F.lit(value))
