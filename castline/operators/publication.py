"""What a batch publishes: duplicates within it, the version that counts, manifests as rows, parts by precedence, runs, requests.

Manifests are rows (slot, profile_id, ...) throughout, so a hot slot is spread like any other rows; lists are made by the
manifest's writer alone, in parts of bounded length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Members in one part of a written manifest at most.
PART_MEMBERS = 10_000


def dedupe(occurrences: DataFrame) -> DataFrame:
    """identity, n, first (least ordinal), outcome: single, identical_duplicate, or conflict where content or revision differ.

    ``occurrences``: identity, ordinal, hash, revision (any type that can be compared); a null differs from every value. A hot identity is folded in each task.
    """
    content = F.struct("hash", "revision")
    made = occurrences.groupBy("identity").agg(F.count("*").alias("n"), F.min("ordinal").alias("first"), F.min(content).alias("_lo"), F.max(content).alias("_hi"))
    outcome = F.when(~F.col("_lo").eqNullSafe(F.col("_hi")), "conflict").when(F.col("n") > 1, "identical_duplicate").otherwise("single")
    return made.select("identity", "n", "first", outcome.alias("outcome"))


def last_accepted(occurrences: DataFrame) -> DataFrame:
    """chunk, profile_id, ordinal, slot, n: of a profile accepted several times in a chunk the last occurrence counts.

    ``occurrences``: chunk, profile_id, ordinal, outcome, slot; accepted ones are inserts and newer revisions, ``n`` counts them.
    """
    accepted = occurrences.where(F.col("outcome").isin("insert", "newer"))
    made = accepted.groupBy("chunk", "profile_id").agg(F.max(F.struct("ordinal", "slot")).alias("_m"), F.count("*").alias("n"))
    return made.select("chunk", "profile_id", "_m.ordinal", "_m.slot", "n")


def edited_manifest(listed: DataFrame, accepted: DataFrame) -> DataFrame:
    """slot, profile_id, profile_hash, levels, origin (kept, added): the manifests of changed slots after a commit.

    ``listed``: slot, profile_id, profile_hash, levels as they stand; ``accepted``: the same columns of what the batch holds in the end, one
    row a profile. A slot changes if an accepted profile enters it or leaves it; such profiles are taken from every slot and added to
    their own. Rows come out sorted by slot and profile_id, dealt out by ranges of both.
    """
    columns = ("slot", "profile_id", "profile_hash", "levels")
    moved = accepted.select("profile_id").distinct()
    changed = accepted.select("slot").unionByName(listed.join(moved, "profile_id", "left_semi").select("slot")).distinct()
    kept = listed.join(moved, "profile_id", "left_anti").join(changed, "slot", "left_semi").select(*columns, F.lit("kept").alias("origin"))
    rows = kept.unionByName(accepted.select(*columns, F.lit("added").alias("origin")))
    return rows.repartitionByRange("slot", "profile_id").sortWithinPartitions("slot", "profile_id")


def manifest_parts(members: DataFrame, most: int = PART_MEMBERS) -> DataFrame:
    """slot, part, n, levels, members (array of profile_id, profile_hash, levels by id): lists of at most ``most``, of ``members`` as rows.

    Parts of a slot follow each other by id, so that its whole list is its parts' lists one after the other.
    """
    place = F.row_number().over(W.partitionBy("slot").orderBy("profile_id")) - 1
    entry = F.struct("profile_id", "profile_hash", "levels")
    return members.withColumn("part", F.floor(place / most).cast("long")).groupBy("slot", "part").agg(
        F.count("*").alias("n"), F.sum("levels").cast("long").alias("levels"), F.array_sort(F.collect_list(entry)).alias("members")
    )


def newest_part(rows: DataFrame, manifest: DataFrame, *keys: str) -> DataFrame:
    """``rows`` that ``manifest`` lists, each key from its newest part alone.

    ``rows``: keys (identity and hash), generation, ...; ``manifest``: keys, ... Rows of one key within one part all stay.
    """
    listed = rows.join(manifest.select(*keys).distinct(), list(keys), "left_semi")
    newest = listed.groupBy(*keys).agg(F.max("generation").alias("generation"))
    return listed.join(newest, [*keys, "generation"], "left_semi")


def merge_check(rows: DataFrame, manifest: DataFrame, *keys: str) -> DataFrame:
    """slot, listed, found, levels_listed, levels_found, complete: what was merged against what the manifest says of each slot.

    ``manifest``: slot, keys, levels. A slot is complete if every member was found with as many levels as listed.
    """
    found = rows.groupBy(*keys).agg(F.count("*").alias("_found"))
    both = manifest.select("slot", *keys, "levels").join(found, list(keys), "left")
    same = F.coalesce(F.col("_found") == F.col("levels"), F.lit(False))
    return both.groupBy("slot").agg(
        F.count("*").alias("listed"), F.count("_found").alias("found"), F.sum("levels").cast("long").alias("levels_listed"), F.coalesce(F.sum("_found"), F.lit(0)).alias("levels_found"), F.bool_and(same).alias("complete")
    )


def latest_runs(environments: DataFrame, runs: DataFrame, manifests: DataFrame) -> DataFrame:
    """environment_id, completed_runs, latest_run_id, reference_time, ingested_at, retrieved_from, retrieved_to.

    ``environments``: environment_id; ``runs``: run_id, environment_id, closed, state, mode, reference_time, created_at; ``manifests``: run_id, retrieved_at.
    Closed runs that are complete or partial count; the latest is the one of newest reference time, then creation (then id), and not a
    historical one. An environment without any is listed with nulls.
    """
    done = runs.where("closed AND state IN ('complete', 'partial')")
    order = F.struct("reference_time", "created_at", "run_id")
    counted = done.groupBy("environment_id").agg(F.count("*").alias("completed_runs"), F.max(F.when(F.coalesce(F.col("mode"), F.lit("")) != "historical", order)).alias("_m"))
    window = manifests.groupBy(F.col("run_id").alias("latest_run_id")).agg(F.min("retrieved_at").alias("retrieved_from"), F.max("retrieved_at").alias("retrieved_to"))
    made = environments.select("environment_id").join(counted, "environment_id", "left")
    made = made.select("environment_id", F.coalesce("completed_runs", F.lit(0)).alias("completed_runs"), F.col("_m.run_id").alias("latest_run_id"), F.col("_m.reference_time").alias("reference_time"), F.col("_m.created_at").alias("ingested_at"))
    return made.join(window, "latest_run_id", "left").select("environment_id", "completed_runs", "latest_run_id", "reference_time", "ingested_at", "retrieved_from", "retrieved_to")


def request_digest(*fields: str) -> Column:
    """sha256 of the canonical form of a request: its fields by name, nulls written out, without blanks."""
    return F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256)


def group_requests(requests: DataFrame, *fields: str) -> DataFrame:
    """request (digest), job (the first by created_at, then job_id), attached (how many share it), of ``requests``: job_id, created_at and the canonical fields."""
    first = F.min(F.struct("created_at", "job_id")).alias("_m")
    return requests.withColumn("request", request_digest(*fields)).groupBy("request").agg(first, F.count("*").alias("attached")).select("request", F.col("_m.job_id").alias("job"), "attached")


def sets_equal(before: DataFrame, data: DataFrame, after: DataFrame) -> DataFrame:
    """n_before, n_data, n_after, n_common, equal: one row, from one pass over the three sets (same columns; repeats count once)."""
    keys = before.columns
    names = ("before", "data", "after")
    rows = None
    for name, df in zip(names, (before, data, after), strict=True):
        part = df.select(*keys, *[F.lit(n == name).alias(f"_{n}") for n in names])
        rows = part if rows is None else rows.unionByName(part)
    each = rows.groupBy(*keys).agg(*[F.bool_or(f"_{n}").alias(f"_{n}") for n in names])
    common = F.col("_before") & F.col("_data") & F.col("_after")
    made = each.agg(*[F.count_if(f"_{n}").alias(f"n_{n}") for n in names], F.count_if(common).alias("n_common"), F.count("*").alias("_all"))
    return made.withColumn("equal", F.col("n_common") == F.col("_all")).drop("_all")
