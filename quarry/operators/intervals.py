"""Spans and places within files: containment joins, and overlaps taken out in order of rank.

Both run as sweeps over sorted rows, so that no pairs are made: what is held is the spans that are open at a place.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Units (bytes, lines ...) of a bin. A file is cut into bins, so that no file is one task's; a span stands in each bin that it covers.
BIN = 1 << 16


def containing(points: DataFrame, spans: DataFrame, key: str = "file_path", width: int = BIN) -> DataFrame:
    """Each row of points (key, at, ...) with span_start, span_end and span_id of the innermost of spans (key, start, end, id) that holds it, or nulls.

    A span holds start <= at < end. The innermost begins last; of those the one that ends first, then the smallest id. Spans may cross each
    other. Null keys and places have no span, empty spans hold nothing; rows of points come out as often as they stand, with all their columns.
    Bins of a file are swept one by one: spans are opened where they begin and left where a place lies beyond them.
    """
    kind, names = dict(spans.dtypes)["id"], [*points.columns, "span_start", "span_end", "span_id"]
    bins = F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))
    opened = spans.filter("start < end").select(F.col(key).cast("string").alias("key"), F.explode(bins).alias("bin"), F.col("start").cast("long").alias("pos"), (-F.col("end")).cast("long").alias("turn"), "id", F.lit(None).cast(points.schema).alias("row"))
    asked = points.select(F.col(key).cast("string").alias("key"), F.floor(F.col("at") / width).alias("bin"), F.col("at").cast("long").alias("pos"), F.lit(1).cast("long").alias("turn"), F.lit(None).cast(kind).alias("id"), F.struct("*").alias("row"))
    # at one place spans come before points, larger ones before smaller ones; of equal spans the smallest id is opened last
    events = opened.unionByName(asked).repartition("key", "bin").sortWithinPartitions("key", "bin", "pos", "turn", F.desc("id"))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, stack = None, []
        for batch in batches:
            taken, found = [], []
            columns = [batch.column(c).to_pylist() for c in ("key", "bin", "pos", "turn", "id")]
            for i, (name, number, pos, turn, own) in enumerate(zip(*columns, strict=True)):
                if group != (name, number):
                    group, stack = (name, number), []
                if turn < 0:
                    stack.append((pos, -turn, own))
                    continue
                if pos is None or name is None:
                    best = (None,) * 3
                else:
                    while stack and stack[-1][1] <= pos:
                        stack.pop()
                    best = stack[-1] if stack else (None,) * 3
                taken.append(i)
                found.append(best)
            if taken:
                starts, ends, ids = zip(*found, strict=True)
                rows = batch.column("row").take(pa.array(taken))
                yield pa.RecordBatch.from_arrays([*rows.flatten(), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(ids, batch.schema.field("id").type)], names)

    schema = T.StructType([*points.schema, T.StructField("span_start", T.LongType()), T.StructField("span_end", T.LongType()), T.StructField("span_id", spans.schema["id"].dataType)])
    return events.mapInArrow(sweep, schema)


def islands(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans (keys, start_byte, end_byte, ...) with ``island``: spans of different islands of a key don't overlap."""
    order = Window.partitionBy(*keys).orderBy("start_byte", "end_byte")
    reach = F.max("end_byte").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((F.col("start_byte") >= reach).cast("int"), F.lit(1))
    # an empty span, or one that repeats another, stays beside it
    return spans.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order)).drop("fresh")


class _Kept:
    """Spans kept so far over sorted places: the last start and the first end of those that hold a place strictly within."""

    def __init__(self, places: list[int]):
        self.at = {p: i for i, p in enumerate(places)}
        self.size = len(places)
        self.last_start, self.first_end = [-1] * (2 * self.size), [1 << 62] * (2 * self.size)

    def add(self, start: int, end: int) -> None:
        lo, hi = self.at[start] + 1 + self.size, self.at[end] + self.size
        while lo < hi:
            for i in ((lo,) if lo & 1 else ()) + ((hi - 1,) if hi & 1 else ()):
                self.last_start[i], self.first_end[i] = max(self.last_start[i], start), min(self.first_end[i], end)
            lo, hi = (lo + 1) >> 1, hi >> 1

    def crosses(self, start: int, end: int) -> bool:
        i = self.at[start] + self.size
        while i:
            if self.first_end[i] < end:
                return True
            i >>= 1
        i = self.at[end] + self.size
        while i:
            if self.last_start[i] > start:
                return True
            i >>= 1
        return False


def best_first(starts: list[int], ends: list[int]) -> list[bool]:
    """Which spans stay, taken in order: one that equals or crosses a kept one goes; containment stays."""
    kept, seen, out = _Kept(sorted({*starts, *ends})), set(), []
    for start, end in zip(starts, ends, strict=True):
        stays = (start, end) not in seen and not kept.crosses(start, end)
        if stays:
            seen.add((start, end))
            kept.add(start, end)
        out.append(stays)
    return out


def drop_overlaps(ranked: DataFrame) -> DataFrame:
    """Rows (query_id, rank, file_path, start_byte, end_byte, ...), best first, less those that equal or cross a kept one of their query and file.

    For lists of any length: only overlapping spans of a file are looked at together, by their ranks, in n log n steps. Ranks of a query differ; of equal ones the
    first span counts. Spans with a null place stay. Columns stay as they are.
    """
    whole = ranked.filter("start_byte is not null and end_byte is not null and file_path is not null")
    rows = islands(whole, ["query_id", "file_path"])

    keys = ["query_id", "file_path", "island"]
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, F.asc_nulls_last("rank"), "start_byte", "end_byte")

    def greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the group that the rows read so far end with

        def settled(batch: pa.RecordBatch, cuts: list[int]) -> pa.RecordBatch:
            starts, ends = (batch.column(c).to_pylist() for c in ("start_byte", "end_byte"))
            stay = [x for lo, hi in zip(cuts, cuts[1:], strict=False) for x in best_first(starts[lo:hi], ends[lo:hi])]
            return batch.slice(0, len(stay)).filter(pa.array(stay, pa.bool_())).select(names)

        own = lambda batch, i: [batch.column(c)[i].as_py() for c in keys]
        for batch in batches:
            if not batch.num_rows:
                continue
            if held and own(held[0], 0) == own(batch, batch.num_rows - 1):
                held.append(batch)
                continue
            whole = pa.concat_batches([*held, batch])
            groups = list(zip(*(whole.column(c).to_pylist() for c in keys), strict=True))
            cuts = [i for i, g in enumerate(groups) if not i or g != groups[i - 1]]
            if len(cuts) > 1:
                yield settled(whole, cuts)
            held = [whole.slice(cuts[-1])]
        if held:
            whole = pa.concat_batches(held)
            yield settled(whole, [0, whole.num_rows])

    names = ranked.columns
    kept = rows.mapInArrow(greedy, ranked.schema)
    return kept.unionByName(ranked.filter("start_byte is null or end_byte is null or file_path is null"))
