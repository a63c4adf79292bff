"""Cutting texts into segments with byte and line places."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lines(docs: DataFrame) -> DataFrame:
    """(row_id, line, line_text, start_byte, end_byte): lines with their ends, 1-based, half-open bytes."""
    parts = F.split(F.col("text"), "(?<=\n)", -1)
    rows = docs.select("row_id", F.posexplode(parts).alias("at", "line_text")).filter("line_text <> ''")
    before = Window.partitionBy("row_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.octet_length("line_text")).over(before)
    return rows.withColumn("end_byte", end.cast("long")).select("row_id", (F.col("at") + 1).alias("line"), "line_text", (F.col("end_byte") - F.octet_length("line_text")).alias("start_byte"), "end_byte")


def by_header(docs: DataFrame, header: str) -> DataFrame:
    """(row_id, segment, start_line, end_line, start_byte, end_byte): from each line that fits ``header`` to the next one."""
    order = Window.partitionBy("row_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines(docs).withColumn("segment", F.sum(F.col("line_text").rlike(header).cast("int")).over(order)).filter("segment > 0")
    return rows.groupBy("row_id", "segment").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.min("start_byte").alias("start_byte"), F.max("end_byte").alias("end_byte"))


def by_size(docs: DataFrame, limit: int = 300) -> DataFrame:
    """(row_id, segment, start_line, end_line, start_byte, end_byte): runs of whole lines of about ``limit`` non-blank characters.

    A line belongs to the segment in which its first non-blank character falls, so a longer line makes the next segments empty: they are left out.
    """
    solid = F.length(F.regexp_replace("line_text", r"\s", ""))
    before = Window.partitionBy("row_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    rows = lines(docs).withColumn("segment", F.floor(F.coalesce(F.sum(solid).over(before), F.lit(0)) / limit))
    return rows.groupBy("row_id", "segment").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.min("start_byte").alias("start_byte"), F.max("end_byte").alias("end_byte"))


def places(chunks: DataFrame) -> DataFrame:
    """Chunks (corpus_id, file_path, place, chunk_text) with the bytes and lines they have when a file's chunks are joined in order."""
    of_file = Window.partitionBy("corpus_id", "file_path").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.length("chunk_text") - F.length(F.replace("chunk_text", F.lit("\n"), F.lit("")))
    start, line = F.coalesce(F.sum(F.octet_length("chunk_text")).over(of_file), F.lit(0)), F.coalesce(F.sum(ends).over(of_file), F.lit(0)) + 1
    rows = chunks.withColumns({"start_byte": start.cast("long"), "start_line": line.cast("int"), "line_ends": ends})
    last = F.col("start_line") + F.col("line_ends") - F.when(F.col("chunk_text").endswith("\n"), 1).otherwise(0)
    return rows.withColumns({"end_byte": F.col("start_byte") + F.octet_length("chunk_text"), "end_line": last}).drop("line_ends")


def join_files(chunks: DataFrame) -> DataFrame:
    """(corpus_id, file_path, text): the chunks (corpus_id, file_path, place, chunk_text) of each file in order; a file fits one row."""
    lists = chunks.groupBy("corpus_id", "file_path").agg(F.array_sort(F.collect_list(F.struct("place", "chunk_text"))).alias("parts"))
    return lists.select("corpus_id", "file_path", F.array_join(F.transform("parts", lambda p: p["chunk_text"]), "").alias("text"))


def align(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks (file_path, place, chunk_text, start_line, ...) with start_byte, end_byte and verbatim: where their texts stand in files (file_path, text).

    Chunks are looked for in order of ``place``, each from the end of the one before; a text that isn't there from that point on is put at the start of its line (from 1;
    the end of the file, if it has fewer lines), and the next search goes on behind it. Null texts are empty, and stand where the search is; chunks of unknown files have null places. A file and its
    chunks fit one row.
    """
    kept = [c for c in chunks.columns if c not in ("start_byte", "end_byte", "verbatim")]
    lists = chunks.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("chunk_text", F.lit("")).alias("chunk_text"), "start_line"))).alias("parts"))
    both = lists.join(files.select("file_path", F.coalesce("text", F.lit("")).alias("text")), "file_path")
    place = dict(chunks.dtypes)["place"]

    def run(batches):
        for batch in batches:
            out = []
            for path, parts, text in zip(*(batch.column(c).to_pylist() for c in ("file_path", "parts", "text")), strict=True):
                data, cursor = text.encode(), 0
                line_starts = [0, *(i + 1 for i, b in enumerate(data) if b == 10)]
                for part in parts:
                    own, line = part["chunk_text"].encode(), part["start_line"]
                    start = data.find(own, cursor)
                    verbatim = start >= 0
                    if not verbatim:
                        start = line_starts[line - 1] if line is not None and 0 < line <= len(line_starts) else len(data)
                    cursor = start + len(own)
                    out.append((path, part["place"], start, cursor, verbatim))
            if out:
                types = [pa.string(), batch.schema.field("parts").type.value_type.field("place").type, pa.int64(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["file_path", "place", "start_byte", "end_byte", "verbatim"])

    found = both.mapInArrow(run, f"file_path string, place {place}, start_byte long, end_byte long, verbatim boolean")
    return chunks.select(kept).join(found.dropDuplicates(["file_path", "place"]), ["file_path", "place"], "left").select(*kept, "start_byte", "end_byte", "verbatim")
