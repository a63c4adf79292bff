"""JSON arrays of objects in files of any size, read by as many tasks as the files have splits.

Spark cuts a file after ``}``, so that one long line splits as well. Whether a split begins within a string, and how deep, isn't known to
its task; so a first pass sums up each split for both cases: the change of depth, and how many objects end at each depth. A scan over the splits of a file, one small row
each, gives every split its true beginning and the number of elements before it. The second pass cuts elements at their borders; those
that lie within a split are parsed there, and only the pieces of those across a border are shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ESCAPE = re.compile(r"\\.", re.S)
_LEAD = re.compile(r"[\s,]*")
SUMMARY = "file string, block long, quoted boolean, flips boolean, depth int, least int, ends map<int, long>, first string, last string"


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, piece): a file's text between ``}``, in order within a split."""
    rows = spark.read.option("lineSep", "}").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("piece"))


def _parts(piece: str, quoted: bool) -> tuple[list[str], bool]:
    """What of a piece lies outside strings, and whether it ends within one."""
    parts = _ESCAPE.sub("__", piece).split('"')
    return parts[int(quoted) :: 2], quoted ^ (len(parts) % 2 == 0)


def _change(parts: list[str]) -> int:
    return sum(p.count("{") + p.count("[") - p.count("}") - p.count("]") for p in parts)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """One row for each split and beginning (outside or within a string)."""
    split, state, edges = None, {}, ["", ""]

    def row() -> pd.DataFrame:
        return pd.DataFrame([(*split, q, s["quoted"] != q, s["depth"], s["least"], dict(s["ends"]), *edges) for q, s in state.items()], columns=[c.split()[0] for c in SUMMARY.replace("map<int, long>", "map").split(", ")])

    for frame in batches:
        for file, block, piece in zip(frame["file"], frame["block"], frame["piece"], strict=True):
            if (file, block) != split:
                if split:
                    yield row()
                split, edges = (file, block), [piece.lstrip()[:1], ""]
                state = {q: {"quoted": q, "depth": 0, "least": 0, "ends": Counter()} for q in (False, True)}
            edges[1] = piece
            for s in state.values():
                parts, s["quoted"] = _parts(piece, s["quoted"])
                s["depth"] += _change(parts)
                if not s["quoted"]:
                    s["depth"] -= 1
                    s["ends"][s["depth"]] += 1
                s["least"] = min(s["least"], s["depth"])
    if split:
        yield row()


def _beginnings(splits: pd.DataFrame) -> pd.DataFrame:
    """(file, block, quoted, depth, before) of each split of a file: how it begins, and how many elements end before it."""
    out, quoted, depth, before = [], False, 0, 0
    rows = {(r.block, r.quoted): r for r in splits.itertuples()}
    blocks = sorted({b for b, _ in rows})
    head, tail = rows[blocks[0], False].first, rows[blocks[-1], False].last.rstrip()
    for block in blocks:
        out.append((splits["file"].iloc[0], block, quoted, depth, before))
        r = rows[block, quoted]
        before += dict(r.ends).get(1 - depth, 0)
        quoted, depth = quoted ^ r.flips, depth + r.depth
    # the last piece has no } behind it, which the sums have taken to be there
    if head != "[" or not tail.endswith("]") or quoted or depth != -1:
        raise ValueError(f"not a JSON array of objects: {splits['file'].iloc[0]}")
    return pd.DataFrame(out, columns=["file", "block", "quoted", "depth", "before"])


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(file, element, block, whole, text): elements, and what a split has of those that begin before it or end after it."""
    split = None
    for frame in batches:
        out = []
        for file, block, piece, quoted, depth, before in frame.itertuples(index=False):
            if (file, block) != split:
                if split and held:
                    out.append((*split[:1], number, split[1], False, "".join(held)))
                split, inside, deep, number, held, begun = (file, block), quoted, depth, before, [], depth <= 1 and not quoted
            parts, inside = _parts(piece, inside)
            deep += _change(parts)
            held.append(piece)
            if not inside:
                deep -= 1
            held.append("}")
            if not inside and deep == 1:
                out.append((file, number, block, begun, "".join(held)))
                number, held, begun = number + 1, [], True
        if out:
            yield pd.DataFrame(out, columns=["file", "element", "block", "whole", "text"])
    if split and held:
        yield pd.DataFrame([(split[0], number, split[1], False, "".join(held))], columns=["file", "element", "block", "whole", "text"])


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, element, value) of all objects of JSON arrays: value by the schema, and the job fails at one that can't be parsed.

    An array holds objects only; an empty one has no rows. Commas between elements are not asked for.
    """
    pieces = _pieces(spark, path)
    sums = pieces.mapInPandas(_summaries, SUMMARY)
    begin = sums.groupBy("file").applyInPandas(_beginnings, "file string, block long, quoted boolean, depth int, before long")
    known = pieces.join(F.broadcast(begin), ["file", "block"]).select("file", "block", "piece", "quoted", "depth", "before")  # a row of begin for each split
    parts = known.mapInPandas(_cut, "file string, element long, block long, whole boolean, text string")
    # a split cuts an element into a few pieces; the end of the file behind the last element isn't one
    torn = parts.filter("not whole").groupBy("file", "element").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda p: p["text"]), "").alias("text"))
    texts = parts.filter("whole").select("file", "element", "text").unionByName(torn)
    lead = F.regexp_replace("text", r"^[\s,]*(\[\s*(?=[{}\]]))?[\s,]*", "")
    rows = texts.select("file", "element", lead.alias("text")).filter("text not like ']%'")
    return rows.select("file", "element", F.from_json("text", schema, {"mode": "FAILFAST"}).alias("value"))
