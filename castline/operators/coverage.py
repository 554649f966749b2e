"""Coverage of a request by committed receipts: every degree of every tile, the whole time, or the gap has a name.

A slot is a month of a 10-degree tile. A receipt covers a rectangle of whole degrees over an interval, and speaks for
the slot it names. Time is proved degree by degree: the intervals of each (slot, degree cell), clipped to the month and the
request, must leave nothing between the start and the end. Receipts meet slots by an equi join and are spread over the
cells of their rectangle, 100 at most; a window over (slot, cell) sweeps them, so no slot and no receipt list is ever in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from castline.functions.geo import TILE

SLOT = ("month", "west", "south")
# Why a slot is not covered.
GAPS = ("fetch_coverage", "missing_active_generation", "stored_empty_not_verified")
EMPTY, WHOLE_SLOT_EMPTY, ABSENT = "empty_stored_", "empty_stored_domain", "source_absence_over_retained"


def request_slots(request: DataFrame, tiles: DataFrame) -> DataFrame:
    """month, west, south, start, end: the slots of requests (request_start, request_end) over tiles (west, south), each with its piece of time."""
    months = F.explode(F.sequence(F.trunc("request_start", "month"), F.trunc(F.col("request_end") - F.expr("INTERVAL 1 MICROSECOND"), "month"), F.expr("INTERVAL 1 MONTH")))
    each = request.where("request_start < request_end").select("*", months.alias("month")).crossJoin(F.broadcast(tiles.select("west", "south").distinct()))  # the tiles of a request, 90 at most
    start = F.greatest(F.col("month").cast("timestamp"), F.col("request_start"))
    end = F.least(F.add_months("month", 1).cast("timestamp"), F.col("request_end"))
    return each.select(*SLOT, start.alias("start"), end.alias("end")).distinct()


def fully_covered(slots: DataFrame, receipts: DataFrame) -> DataFrame:
    """month, west, south of the slots whose every degree cell is covered over the slot's whole piece by ``receipts``.

    ``receipts``: month, west, south (the slot they speak for), r_start, r_end, r_west, r_south, r_width, r_height (whole degrees).
    """
    met = slots.join(receipts, list(SLOT)).where((F.col("r_start") < F.col("end")) & (F.col("r_end") > F.col("start")))

    def degrees(first: str, size: str, low: Column) -> Column:
        a, b = F.greatest(F.col(first), low), F.least(F.col(first) + F.col(size), low + TILE) - 1
        return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<long>"))

    cells = met.select(*SLOT, "start", "end", F.greatest("r_start", "start").alias("a"), F.least("r_end", "end").alias("b"), F.explode(degrees("r_west", "r_width", F.col("west"))).alias("x"), "r_south", "r_height")
    cells = cells.select(*SLOT, "start", "end", "a", "b", "x", F.explode(degrees("r_south", "r_height", F.col("south"))).alias("y"))
    # Equal pieces of one cell are one piece.
    cells = cells.groupBy(*SLOT, "start", "end", "x", "y", "a").agg(F.max("b").alias("b"))
    w = W.partitionBy(*SLOT, "start", "end", "x", "y").orderBy("a", "b")
    reached = F.coalesce(F.max("b").over(w.rowsBetween(W.unboundedPreceding, -1)), F.col("start"))
    swept = cells.withColumn("hole", F.col("a") > reached)
    whole = swept.groupBy(*SLOT, "start", "end", "x", "y").agg(F.bool_or("hole").alias("hole"), F.max("b").alias("last")).where(~F.col("hole") & (F.col("last") >= F.col("end")))
    return whole.groupBy(*SLOT, "start", "end").agg(F.count("*").alias("cells")).where(F.col("cells") == TILE * TILE).select(*SLOT, "start", "end")


def resolve(slots: DataFrame, receipts: DataFrame, versions: DataFrame, parts: DataFrame, members: DataFrame) -> DataFrame:
    """A row for each slot: month, west, south, start, end, n_members, gaps, parts, verified, absences (sorted arrays), state.

    ``receipts`` as in ``fully_covered``, and receipt_id, slot_version, fetch_disposition, stored_disposition; ``versions``: the
    current slot_version of each slot; ``parts``: part_id of each slot's active parts; ``members``: month, west, south, at of the
    profiles listed.
    """
    on = [*SLOT, "start", "end"]
    yes = lambda df, name: df.select(*on, F.lit(True).alias(name))
    fetched = yes(fully_covered(slots, receipts), "fetched")
    current = receipts.join(versions, [*SLOT, "slot_version"], "left_semi")
    empty = current.where(F.col("stored_disposition").startswith(EMPTY))
    proved = yes(fully_covered(slots, empty), "proved")
    listed = members.join(slots, list(SLOT)).where((F.col("at") >= F.col("start")) & (F.col("at") < F.col("end"))).groupBy(*on).agg(F.count("*").alias("n_members"))
    ids = lambda df, c, name: df.groupBy(*SLOT).agg(F.array_sort(F.collect_set(c)).alias(name))  # noqa: E731  a slot has few parts and receipts
    whole = empty.where(F.col("stored_disposition") == WHOLE_SLOT_EMPTY)
    rows = slots
    for found in (fetched, proved, listed):
        rows = rows.join(found, on, "left")
    for found in (ids(parts, "part_id", "parts"), ids(empty, "receipt_id", "_empty"), ids(whole, "receipt_id", "_whole"), ids(current.where(F.col("fetch_disposition") == ABSENT), "receipt_id", "_absent")):
        rows = rows.join(found, list(SLOT), "left")
    none = F.array().cast("array<string>")
    held, stands = F.coalesce("n_members", F.lit(0)) > 0, F.coalesce("proved", F.lit(False)) | F.col("_whole").isNotNull()
    gaps = F.array_compact(F.array(*[F.when(test, F.lit(gap)) for test, gap in zip((F.col("fetched").isNull(), held & F.col("parts").isNull(), ~held & ~stands), GAPS, strict=True)]))
    strings = lambda c: F.coalesce(c.cast("array<string>"), none)
    return rows.select(
        *on, F.coalesce("n_members", F.lit(0)).cast("long").alias("n_members"), gaps.alias("gaps"), F.when(held, strings(F.col("parts"))).otherwise(none).alias("parts"),
        F.when(~held & stands, strings(F.coalesce("_whole", "_empty"))).otherwise(none).alias("verified"), F.when(held, strings(F.col("_absent"))).otherwise(none).alias("absences"),
    ).withColumn("state", F.when(F.size("gaps") > 0, F.get("gaps", F.lit(0))).when(held, "covered").otherwise("empty_verified"))
