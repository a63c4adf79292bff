"""Refresh of the tables of files and symbols after a scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import code, maintain

FILES = "file_path string, hash string, mtime long, file_size long, language string, chunk_count long"
CHUNKS = f"row_id long, {code.SCHEMA}"


def empty(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Tables of files and chunks without rows."""
    return spark.createDataFrame([], FILES), spark.createDataFrame([], CHUNKS)


def refresh(found: DataFrame, files: DataFrame, chunks: DataFrame, force: bool = False, complete: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, chunks, stats) after a scan ``found`` (file_path, language, text, hash, mtime, file_size, error).

    Only changed files are cut anew, all with ``force``. A file with an error keeps its old rows and isn't counted. Stored
    files that weren't found go, unless the scan isn't ``complete``. Write both tables as one new version; stats: (n_files,
    n_chunks, n_failed) of this run.
    """
    news = found if force else found.join(maintain.changed(found.select("file_path", "hash"), files.select("file_path", "hash")).select("file_path"), "file_path", "left_semi")
    good = news.filter(F.col("error").isNull() & F.col("text").isNotNull())
    rows = code.symbols(good)
    gone = maintain.gone(found, files).select("file_path") if complete else files.limit(0).select("file_path")
    kept = chunks.join(gone, "file_path", "left_anti").select(chunks.columns)
    counts = rows.groupBy("file_path").agg(F.count("*").alias("chunk_count"))
    meta = good.join(counts, "file_path", "left").select("file_path", "hash", "mtime", "file_size", "language", F.coalesce("chunk_count", F.lit(0)).cast("long").alias("chunk_count"))
    now_files = maintain.merge(files.join(gone, "file_path", "left_anti").select(files.columns), meta)
    failed = news.agg(F.count(F.when(F.col("error").isNotNull(), 1)).alias("n_failed"))
    stats = meta.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("n_chunks")).join(F.broadcast(failed))
    return now_files, maintain.replace_chunks(kept, rows, good), stats
