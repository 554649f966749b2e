"""Reports of a store: reconciliation of stored profiles with what manifests list, and map clusters for all zooms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The four populations, the side of a cluster in pixels, and the last zoom that clusters.
SCOPES = ("full_stored", "full_snapshot", "run_eligible_stored", "run_eligible_snapshot")
CLUSTER_PX, TILE_PX, MOST_ZOOM = 36, 256, 7
#: Latitude at which the square of the Web Mercator map ends.
MOST_LATITUDE = 85.05112877980659


def reconcile(stored: DataFrame, members: DataFrame, start: str, end: str) -> DataFrame:
    """scope, profiles, levels, digest, balanced: a row for each population, empty ones too.

    ``stored``: profile_id, hash, levels, observed_at; ``members``: profile_id, hash, levels as manifests list them. The eligible ones
    are those that the store observed within [start, end). A population's digest is the sum of its rows' hashes, so it merges
    from task to task and no row set is gathered; ids are unique, so equal sums mean equal sets. ``balanced`` tells whether stored
    and listed ones agree in count, levels and digest.
    """
    inside = (F.col("observed_at") >= F.lit(start).cast("timestamp")) & (F.col("observed_at") < F.lit(end).cast("timestamp"))
    own = stored.select("profile_id", "hash", "levels", inside.alias("_in"))
    listed = members.select("profile_id", "hash", "levels").join(own.select("profile_id", "_in"), "profile_id", "left")
    scoped = lambda df, full, eligible: df.select(F.explode(F.array_compact(F.array(F.lit(full), F.when(F.col("_in"), eligible)))).alias("scope"), "profile_id", "hash", "levels")
    rows = scoped(own, SCOPES[0], SCOPES[2]).unionByName(scoped(listed, SCOPES[1], SCOPES[3]))
    mark = F.conv(F.substring(F.sha2(F.concat_ws("|", "profile_id", "hash", F.col("levels").cast("string")), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    found = rows.groupBy("scope").agg(F.count("*").alias("profiles"), F.sum("levels").cast("long").alias("levels"), F.sum(mark).alias("digest"))
    scopes = stored.sparkSession.createDataFrame([(s, s.replace("stored", "x").replace("snapshot", "x")) for s in SCOPES], "scope string, _pair string")
    made = scopes.join(found, "scope", "left").select("scope", "_pair", F.coalesce("profiles", F.lit(0)).alias("profiles"), F.coalesce("levels", F.lit(0)).alias("levels"), F.coalesce("digest", F.lit(0)).cast("string").alias("digest"))
    pairs = made.groupBy("_pair").agg((F.count_distinct("profiles", "levels", "digest") == 1).alias("balanced"))
    return made.join(pairs, "_pair").drop("_pair")


def map_clusters(points: DataFrame, zooms: range = range(MOST_ZOOM + 1)) -> DataFrame:
    """zoom, cx, cy, n, longitude, latitude: clusters of all zooms from one scan.

    The finest cells are counted once; a coarser zoom halves the map, so its cells are made of four finer ones by their sums.
    """
    top = max(zooms)
    lat = F.radians(F.least(F.greatest(F.col("latitude"), F.lit(-MOST_LATITUDE)), F.lit(MOST_LATITUDE)))
    side = TILE_PX * 2**top / CLUSTER_PX
    cx = F.floor((F.col("longitude") + 180) / 360 * side)
    cy = F.floor((1 - F.log(F.tan(lat) + 1 / F.cos(lat)) / F.pi()) / 2 * side)
    finest = points.groupBy(cx.alias("x"), cy.alias("y")).agg(F.count("*").alias("n"), F.sum("longitude").alias("sx"), F.sum("latitude").alias("sy"))
    levels = finest.select("*", F.explode(F.array(*[F.lit(z) for z in zooms])).alias("zoom"))
    up = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.lit(top) - F.col("zoom"))).cast("long")
    each = levels.groupBy("zoom", up("x").alias("cx"), up("y").alias("cy")).agg(F.sum("n").alias("n"), F.sum("sx").alias("sx"), F.sum("sy").alias("sy"))
    return each.select("zoom", "cx", "cy", "n", (F.col("sx") / F.col("n")).alias("longitude"), (F.col("sy") / F.col("n")).alias("latitude"))
