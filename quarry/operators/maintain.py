"""Incremental upkeep of file tables: what changed, what is gone, and merged rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Files (file_path, hash) that are new, differ, or could not be hashed."""
    old = stored.select("file_path", F.col("hash").alias("old_hash"))
    return found.join(old, "file_path", "left").filter(F.col("hash").isNull() | ~F.col("hash").eqNullSafe(F.col("old_hash"))).drop("old_hash")


def gone(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored files that are no longer found."""
    return stored.join(found, "file_path", "left_anti")


def gone_less(stored: DataFrame, found: DataFrame, complete: bool, drop: list[str] | None = None) -> DataFrame:
    """Stored files less those that a complete scan didn't find and those to be dropped."""
    kept = stored.join(found, "file_path", "left_semi") if complete else stored
    return kept.filter(~F.col("file_path").isin(drop)) if drop else kept


def merge(stored: DataFrame, news: DataFrame, key: str = "file_path") -> DataFrame:
    """Stored rows with those of ``news`` in place of rows with the same key."""
    return stored.join(news, key, "left_anti").unionByName(news)


def replace_chunks(chunks: DataFrame, news: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Chunks with all rows of the files in ``paths`` (those of ``news`` if not given) replaced.

    New rows get larger ids in order of file and place, with gaps: ranges are sorted each for itself, and no task
    counts all rows. Write the result once; a second evaluation may cut other ranges.
    """
    top = chunks.agg(F.coalesce(F.max("row_id"), F.lit(0)).alias("top"))
    order = ["file_path", "start_byte", "end_byte"]
    fresh = news.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    fresh = fresh.join(F.broadcast(top)).withColumn("row_id", F.col("top") + 1 + F.col("at"))
    paths = (news if paths is None else paths).select("file_path").distinct()
    return chunks.join(paths, "file_path", "left_anti").select(chunks.columns).unionByName(fresh.select(chunks.columns))
