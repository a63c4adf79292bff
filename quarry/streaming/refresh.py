"""A stream of source files that keeps an index up to date."""

from __future__ import annotations

from pyspark.sql.streaming import DataStreamWriter

from quarry.app import Index
from quarry.sources import files


def follow(index: Index, root: str, checkpoint: str) -> DataStreamWriter:
    """A writer that takes files appearing below ``root`` into the index, batch by batch; start it with a trigger of choice.

    Each batch is one version of the index. A batch that is run again after a failure finds its files unchanged, so it
    adds nothing. Spark's file source sees each path once: changes and deletions need ``Index.index``.
    """
    spark, config = index.spark, index.config
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("pathGlobFilter", files.NAMES).load(root)

    def take(batch, _: int) -> None:
        index.refresh(files.prepare(batch, root, config.ignore_patterns, config.use_default_ignores, config.languages), complete=False)

    return found.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
