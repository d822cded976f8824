"""Saved states: the latest one and which ones to keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tuneloom.operators.scale import join_groups, top_n

# Fixed value: the directory name of a saved state.
CHECKPOINT_NAME = r"^checkpoint-([0-9]+)\z"


def numbered(manifest: DataFrame) -> DataFrame:
    """Add the ``number`` of saved states to a manifest (run_id, path, is_dir); null for the rest."""
    name = F.substring_index(F.rtrim("path", F.lit("/")), "/", -1)
    digits = "__digits"
    # Only digits are cast: a try_cast that fails costs an exception per row. Numbers beyond
    # 64 bits are no step numbers.
    number = F.when(F.col("is_dir") & (F.col(digits) != ""), F.col(digits).try_cast("bigint"))
    named = manifest.withColumn(digits, F.regexp_extract(name, CHECKPOINT_NAME, 1))
    return named.withColumn("number", number).drop(digits)


def checkpoints(manifest: DataFrame) -> DataFrame:
    """The rows of a manifest that are saved states."""
    return numbered(manifest).where(F.col("number").isNotNull())


def latest_checkpoint(manifest: DataFrame) -> DataFrame:
    """Path of the highest-numbered saved state of every run; null for runs without one."""
    newest = F.when(F.col("number").isNotNull(), F.struct("number", "path"))
    return (
        numbered(manifest)
        .groupBy("run_id")
        .agg(F.max_by("path", newest).alias("path"), F.max("number").alias("number"))
    )


def checkpoint_retention(manifest: DataFrame, save_total_limit: int = 2) -> DataFrame:
    """Mark the newest saved states of each run ``keep`` and the others ``drop``."""
    saved = checkpoints(manifest)
    oldest_kept = (
        top_n(saved, save_total_limit, [F.desc("number"), F.desc("path")], ["run_id"])
        .groupBy("run_id")
        .agg(F.min(F.struct("number", "path")).alias("__oldest"))
    )
    joined = join_groups(saved, oldest_kept, ["run_id"])
    kept = F.struct("number", "path") >= F.col("__oldest")
    return joined.select(
        "run_id", "path", "number", F.when(kept, F.lit("keep")).otherwise(F.lit("drop")).alias("action")
    )
