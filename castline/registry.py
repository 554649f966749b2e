"""Registration of queries: a function over the driver tables beside the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castline.bridge import frames, table, with_views
from castline.functions.qc import qc_value
from castline.sources.store import Store, landed_store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The driver tables and the bridge frames over them, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def bridge(self) -> dict[str, DataFrame]:
        return frames(self.spark, self.sf_dir)

    @property
    def profiles(self) -> DataFrame:
        return self.bridge["profiles"]

    @property
    def levels(self) -> DataFrame:
        return self.bridge["levels"]

    @property
    def delivered(self) -> DataFrame:
        return self.bridge["delivered"]

    @cached_property
    def store(self) -> Store:
        """Headers and levels as a slot store, landed once a session."""
        return landed_store(self.spark, self.sf_dir, self.profiles, self.levels)

    def selected(self, policy: str = "science_ready") -> DataFrame:
        """Levels with their profile's header and the values p, t, s that ``policy`` selects."""
        values = self.levels.select("profile_id", "level_index", *[qc_value(v, policy).alias(v[0]) for v in ("pressure", "temperature", "salinity")])
        return values.join(self.profiles, "profile_id")


def _value(var: str, policy: str) -> str:
    if policy == "mode_selected":
        return f"CASE WHEN {var}_data_mode = 'R' THEN {var} WHEN {var}_data_mode IN ('A','D') THEN {var}_adjusted END"
    return (f"CASE WHEN {var}_data_mode = 'R' AND {var}_qc IN ('1','2') THEN {var} "
            f"WHEN {var}_data_mode IN ('A','D') AND {var}_adjusted_qc IN ('1','2') THEN {var}_adjusted END")  # fmt: skip


def _selected(policy: str) -> str:
    values = ", ".join(f"{_value(v, policy)} AS {v[0]}" for v in ("pressure", "temperature", "salinity"))
    return f"SELECT l.profile_id, l.level_index, {values}, m.* EXCLUDE (profile_id) FROM b_levels l JOIN b_profiles m ON l.profile_id = m.profile_id"


#: Further views of the SQL twins.
VIEWS = {"b_sel": _selected("science_ready"), "b_mode": _selected("mode_selected")}


def query(name: str, sql: str | None = None):
    """Registers a function of ``Tables`` under ``name``."""

    def deco(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            SQL[name] = with_views(sql, **VIEWS)
        return fn

    return deco


#: Two engines add doubles in different orders, so a mean that lies on a tie may round either way. Both
#: sides of a check move it off the tie first.
NUDGE = 1e-9


def r6(column, name: str):
    return F.round(column + NUDGE, 6).alias(name)
