"""Flags of delivered levels: for each variable one array in fixed order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from castline.functions.numeric import exact_numbers
from castline.functions.qc import PLAUSIBLE, VARIABLES
from castline.operators.payload import qc_normalised


def level_flags(levels: DataFrame) -> DataFrame:
    """profile_id, level_index, and for each variable its value, reject and flags.

    ``levels``: profile_id, level_index, and for each variable ``{v}_text`` (the number as delivered), ``{v}_code`` (QC as delivered)
    and ``{v}_present`` (whether its profile has the variable). Order of flags: those of the number (rounded, subnormal), of the QC
    (qc_unknown), outside_plausibility_range, and for pressure repeated_pressure (a level before has the value) and
    nonmonotonic_pressure (less than the last value before). A variable that is not there has variable_absent and nothing else.
    One exchange by profile: both windows stand on it.
    """
    rows = levels
    for v in VARIABLES:
        rows = exact_numbers(rows, f"{v}_text").withColumnsRenamed({"value": v, "reject": f"{v}_reject", "flags": f"{v}_number"})
        rows = rows.withColumn(v, F.when(F.col(f"{v}_present"), F.col(v)))
    w = W.partitionBy("profile_id").orderBy("level_index")
    last = F.last("pressure", True).over(w.rowsBetween(W.unboundedPreceding, -1))
    before = F.row_number().over(W.partitionBy("profile_id", "pressure").orderBy("level_index")) > 1
    rows = rows.withColumn("_last", last).withColumn("_before", before & F.col("pressure").isNotNull())
    none = F.array().cast("array<string>")
    out = []
    for v in VARIABLES:
        low, high = PLAUSIBLE[v]
        _, unknown = qc_normalised(F.col(f"{v}_code"))
        track = [F.when(F.col("_before"), "repeated_pressure"), F.when(F.col("pressure") < F.col("_last"), "nonmonotonic_pressure")] if v == "pressure" else []
        own = F.concat(
            F.coalesce(f"{v}_number", none), F.when(F.coalesce(unknown, F.lit(False)), F.array(F.lit("qc_unknown"))).otherwise(none),
            F.array_compact(F.array(F.when(~F.col(v).between(low, high), "outside_plausibility_range"), *track)),
        )
        flags = F.when(~F.col(f"{v}_present"), F.array(F.lit("variable_absent"))).otherwise(own)
        out += [F.col(v), F.when(F.col(f"{v}_present"), F.col(f"{v}_reject")).alias(f"{v}_reject"), flags.alias(f"{v}_flags")]
    return rows.select("profile_id", "level_index", *out)
