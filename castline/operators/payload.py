"""Rules on delivered profile documents (JSON text), as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The fields of a profile document, the core variables, and how many levels a profile may have.
REQUIRED = ("metadata", "geolocation", "basin", "timestamp", "date_updated_argovis", "source", "cycle_number", "data_info", "data")
OPTIONAL = ("_id", "data_warning", "profile_direction", "geolocation_argoqc", "timestamp_argoqc", "vertical_sampling_scheme")
CORE = ("pressure", "temperature", "salinity")
LEAST_LEVELS, MOST_LEVELS = 1, 10_000


def _listed(names: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, names))


def schema_verdict(json: Column, required: tuple[str, ...] = REQUIRED, optional: tuple[str, ...] = OPTIONAL) -> Column:
    """``invalid_json``, ``unknown_field``, ``missing_field`` or null."""
    keys = F.json_object_keys(json)
    return (
        F.when(keys.isNull(), "invalid_json").when(F.size(F.array_except(keys, _listed(required + optional))) > 0, "unknown_field")
        .when(F.size(F.array_except(_listed(required), keys)) > 0, "missing_field")
    )


def arrays_verdict(names: Column, data: Column) -> Column:
    """``invalid_data_info`` (names missing, repeated or not one for each array), ``invalid_array_length``, ``mismatched_array_lengths`` or null."""
    sizes = F.transform(data, F.size)
    return (
        F.when(names.isNull() | data.isNull() | (F.size(names) == 0) | (F.size(names) != F.size(data)) | (F.size(F.array_distinct(names)) < F.size(names)), "invalid_data_info")
        .when(F.exists(sizes, lambda n: (n < LEAST_LEVELS) | (n > MOST_LEVELS)), "invalid_array_length").when(F.array_min(sizes) != F.array_max(sizes), "mismatched_array_lengths")
    )


def core_names(names: Column) -> tuple[Column, Column]:
    """(core variables among the names in fixed order, how many other arrays): QC arrays count with their variable."""
    bare = F.array_distinct(F.transform(names, lambda n: F.regexp_replace(n, "_argoqc$", "")))
    return F.array_intersect(_listed(CORE), bare), F.size(F.array_except(bare, _listed(CORE)))


def revision_map(sources: Column) -> Column:
    """Component map of a source list (array of struct with source array, url, date_updated).

    A component is the sorted labels and the url. Null if the list is empty or any date is missing, or if a
    component comes twice (see ``revision_reject``).
    """
    return F.when(revision_reject(sources).isNull() & ~F.exists(sources, lambda s: s["date_updated"].isNull()), F.map_from_entries(_components(sources)))


def _components(sources: Column) -> Column:
    key = lambda s: F.to_json(F.struct(F.array_sort(s["source"]).alias("source"), s["url"].alias("url")))
    return F.transform(sources, lambda s: F.struct(key(s).alias("key"), s["date_updated"].alias("value")))


def revision_reject(sources: Column) -> Column:
    """``invalid_source`` (no list), ``duplicate_revision_component`` or null."""
    keys = F.transform(_components(sources), lambda e: e["key"])
    return F.when(sources.isNull() | (F.size(sources) == 0), "invalid_source").when(F.size(F.array_distinct(keys)) < F.size(keys), "duplicate_revision_component")


def qc_normalised(code: Column) -> tuple[Column, Column]:
    """(code if it is one digit, whether a code was given that is not)."""
    known = code.rlike("^[0-9]$")
    return F.when(known, code), F.coalesce((code != "") & ~known, F.lit(False))


# What an upstream warning does.
WARNING_EXCLUDES, WARNING_INFORMS = ("degenerate_levels",), ("missing_basin",)


def warning_action(warnings: Column) -> Column:
    """``quarantine`` for any warning that is not known, else ``exclude``, ``inform`` or ``none``."""
    other = F.size(F.array_except(warnings, _listed(WARNING_EXCLUDES + WARNING_INFORMS))) > 0
    has = lambda names: F.arrays_overlap(warnings, _listed(names))
    return F.when(other, "quarantine").when(has(WARNING_EXCLUDES), "exclude").when(has(WARNING_INFORMS), "inform").otherwise("none")
