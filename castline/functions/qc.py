"""Quality-control selection as Column expressions: which stored variant of a variable counts, and when."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VARIABLES = ("pressure", "temperature", "salinity")
GOOD = ("1", "2")


def qc_value(var: str, policy: str) -> Column:
    """The delivered value of ``var``: original in mode R, adjusted in modes A and D, else null.

    ``science_ready`` also asks for QC 1 or 2 of that same variant; ``mode_selected`` does not.
    ``raw`` is the original column as stored.
    """
    if policy == "raw":
        return F.col(var)
    real, delayed = F.col(f"{var}_data_mode") == "R", F.col(f"{var}_data_mode").isin("A", "D")
    if policy == "science_ready":
        real, delayed = real & F.col(f"{var}_qc").isin(*GOOD), delayed & F.col(f"{var}_adjusted_qc").isin(*GOOD)
    elif policy != "mode_selected":
        raise ValueError(f"unknown policy {policy!r}")
    return F.when(real, F.col(var)).when(delayed, F.col(f"{var}_adjusted"))


def qc_code(var: str) -> Column:
    """QC code of the delivered variant."""
    return F.when(F.col(f"{var}_data_mode") == "R", F.col(f"{var}_qc")).when(
        F.col(f"{var}_data_mode").isin("A", "D"), F.col(f"{var}_adjusted_qc")
    )


def raw_columns(var: str, present: list[str]) -> list[Column]:
    """The stored columns of ``var`` among ``present``, in stored order."""
    return [F.col(c) for c in present if c == var or c.startswith(f"{var}_")]


# What a value may be, and the spellings of units.
PLAUSIBLE = {"pressure": (-5, 12000), "temperature": (-5, 50), "salinity": (0, 50)}
UNIT_SPELLINGS = {"dbar": "dbar", "decibar": "dbar", "degree_C": "degree_C", "degree_Celsius": "degree_C", "degC": "degree_C", "psu": "1", "PSU": "1", "1": "1"}


def implausible() -> Column:
    """Names of the variables (columns) whose value lies outside its range."""
    return F.array_compact(F.array(*[F.when(~F.col(v).between(*ends), v) for v, ends in PLAUSIBLE.items()]))


def canonical_unit(spelling: Column) -> Column:
    """Canonical unit of a spelling; null if nobody knows it."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in UNIT_SPELLINGS.items() for x in pair]), spelling)


def place_variant(var: str, value: Column, code: Column, mode: Column) -> list[Column]:
    """The stored columns of a delivered value and its QC: the original in mode R, the adjusted ones in A and D, null elsewhere."""
    real, delayed = mode == "R", mode.isin("A", "D")
    return [F.when(real, value).alias(var), F.when(delayed, value).alias(f"{var}_adjusted"), F.when(real, code).alias(f"{var}_qc"), F.when(delayed, code).alias(f"{var}_adjusted_qc"), mode.alias(f"{var}_data_mode")]
