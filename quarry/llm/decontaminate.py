"""Benchmark decontamination by SimHash of item-sized windows.

A window of a document has as many words as an item. Shingles are compared as sets, so an item whose parts stand in another
order counts as well. Windows are fingerprinted where their shared shingles have weight enough for the similarity: of these, each
that starts or ends with a shared shingle, for others share no more than one of them. Shared shingles are found with a bitmap of
``BITS`` bits of the items' shingles, whose size is fixed. A fingerprint has 64 bits over the words. Split into 8 blocks of
8 bits, two fingerprints within ``RADIUS`` = 15 bits differ by at most one bit in some block: items are indexed under each
block's value and its 8 neighbours, windows look up their own. Pairs within the radius are verified by
weighted shingle similarity: shared over all weight, where a shingle that f of N items have weighs ln(1 + N / f), and one
that the item doesn't have ln(1 + N).

Items with fewer words than a shingle are one shingle. Null and empty items and texts match nothing. A document shorter than an item is one window.
Ties: the first of the best windows of a document and item. Repeated rows give one result; of different texts of one item the
smallest counts, those of one doc_id are all searched. Rows without an id and extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Words, chunks, list_array, mix, shingles, signed, stored, text_batches

SIZE, SIMILARITY = 5, 0.75
BITS = 1 << 24
RADIUS, BLOCKS = 15, 8


def simhash(words: np.ndarray) -> int:
    """64 bits: the sign of the sum of the words' hash bits, as a signed number."""
    bits = np.unpackbits(mix(words ^ np.uint64(0x5851F42D4C957F2D)).view(np.uint8)).reshape(-1, 64)
    return int(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(words)).view(np.int64)[0])


def _items(items: DataFrame) -> DataFrame:
    """(item_id, n, print, runs): word count, fingerprint and shingles in order of each item with words."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                words = Words(part.column("text"))
                ids, n, prints, runs = [], [], [], []
                for item, a, b in zip(part.column("item_id").to_pylist(), words.bounds[:-1], words.bounds[1:], strict=True):
                    if b > a and item is not None:
                        own = words.hashes[a:b]
                        ids.append(item), n.append(b - a), prints.append(simhash(own)), runs.append(shingles(own, min(SIZE, b - a)))
                flat = np.concatenate(runs) if runs else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int32()), pa.array(prints, pa.int64()), list_array(signed(flat), [len(r) for r in runs])], ["item_id", "n", "print", "runs"])

    text_batches(items.sparkSession)
    one = items.select(F.col("item_id").cast("long"), "text").groupBy("item_id").agg(F.min("text").alias("text"))
    return one.mapInArrow(run, "item_id long, n int, print long, runs array<long>")


def starts(place: np.ndarray, run: np.ndarray, weight: np.ndarray, n: int, m: int, need: float) -> np.ndarray:
    """Starts in a region of m words of windows of n words whose distinct shared shingles weigh ``need`` or more.

    place, run, weight: of the shared shingles, by place. Windows start or end with one of them.
    """
    size = min(SIZE, n)
    found = np.unique(np.clip(np.concatenate([place, place + size - n]), 0, max(0, m - n)))
    lo, hi = np.searchsorted(place, found), np.searchsorted(place, found + n - size, side="right")
    return np.array([s for s, a, b in zip(found.tolist(), lo, hi, strict=True) if weight[a:b][np.unique(run[a:b], return_index=True)[1]].sum() >= need], np.int64)


def _hits(words: np.ndarray, sizes: list[int], bitmap: np.ndarray):
    """Places and shingles of words whose bit is set, by size."""
    for size in sizes:
        found = shingles(words, size)
        slot = (found >> np.uint64(40)).astype(np.int64)
        at = np.flatnonzero(bitmap[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
        yield size, at, found[at]


def find(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity): the best window of each pair that reaches the similarity."""
    spark = docs.sparkSession
    items = stored(_items(items))
    runs = items.select("item_id", "n", F.posexplode("runs").alias("offset", "run"))
    total, longest = items.agg(F.count("*"), F.max("n")).first()
    weights = runs.groupBy("run").agg(F.countDistinct("item_id").alias("f")).withColumn("weight", F.log(1 + F.lit(total) / F.col("f")))
    sizes = sorted(r[0] for r in items.select(F.least("n", F.lit(SIZE))).distinct().collect())
    slots = runs.select(F.shiftrightunsigned("run", 40).alias("slot")).distinct().toArrow().column("slot").to_numpy()
    bitmap = np.zeros(BITS >> 3, np.uint8)
    np.bitwise_or.at(bitmap, slots >> 3, np.uint8(1) << (slots & 7).astype(np.uint8))
    sent = spark.sparkContext.broadcast(bitmap)
    margin = longest or 0

    def regions(batches):
        bitmap = sent.value
        for batch in batches:
            for part in chunks(batch):
                words = Words(part.column("text"))
                mark = np.zeros(len(words.hashes) + 1, bool)
                end_of = np.repeat(words.bounds[1:], np.diff(words.bounds))
                for size, at, _ in _hits(words.hashes, sizes, bitmap):
                    mark[at[at + size <= end_of[at]]] = True
                places = np.flatnonzero(mark)
                if not len(places):
                    continue
                row = np.searchsorted(words.bounds, places, side="right") - 1
                lo, hi = np.maximum(places - margin, words.bounds[row]), np.minimum(places + margin + SIZE, words.bounds[row + 1])
                first = np.append(True, (row[1:] != row[:-1]) | (lo[1:] > hi[:-1]))
                head = np.flatnonzero(first)
                start, end = lo[head], np.maximum.reduceat(hi, head)
                flat = np.concatenate([words.hashes[a:b] for a, b in zip(start, end, strict=True)])
                ids = part.column("doc_id").take(pa.array(row[head]))
                yield pa.RecordBatch.from_arrays([ids, pa.array((start - words.bounds[row[head]]).astype(np.int32)), list_array(signed(flat), end - start)], ["doc_id", "at", "words"])

    text_batches(spark)
    found = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(regions, "doc_id long, at int, words array<long>").filter("doc_id is not null").dropDuplicates(["doc_id", "at", "words"]))

    def hits(batches):
        bitmap = sent.value
        for batch in batches:
            lists = batch.column("words")
            flat, ends = lists.flatten().to_numpy().view(np.uint64), np.cumsum(np.asarray(lists.value_lengths()))
            for i, end in enumerate(ends):
                words = flat[end - lists.value_lengths()[i].as_py() : end]
                for _, at, run in _hits(words, sizes, bitmap):
                    rows = pa.array(np.full(len(at), i))
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("at").take(rows), pa.array(np.full(len(at), len(words), np.int32)), pa.array(at.astype(np.int32)), pa.array(signed(run))], ["doc_id", "at", "m", "place", "run"])

    seeds = found.select("doc_id", "at", "words").mapInArrow(hits, "doc_id long, at int, m int, place int, run long")
    # what a window must share: so much of the item's weight
    known = stored(runs.select("item_id", "n", "run").distinct().join(weights.select("run", "weight"), "run"))
    whole = known.groupBy("item_id").agg((F.sum("weight") * similarity - 1e-9).alias("need"))
    shared = seeds.join(known.join(whole, "item_id"), "run")
    shared = shared.groupBy("doc_id", "at", "m", "item_id", "n", "need").agg(F.sort_array(F.collect_list(F.struct("place", "run", "weight"))).alias("hits"))
    shared = shared.filter(F.aggregate("hits", F.lit(0.0), lambda s, x: s + x["weight"]) >= F.col("need"))

    def pick(batches):
        for batch in batches:
            lists, out = batch.column("hits"), []
            flat, cuts = lists.flatten(), np.cumsum(np.asarray(lists.value_lengths()))[:-1]
            parts = (np.split(flat.field(f).to_numpy(), cuts) for f in ("place", "run", "weight"))
            for i, (hit, n, m, need) in enumerate(zip(zip(*parts, strict=True), *(batch.column(c).to_pylist() for c in ("n", "m", "need")), strict=True)):
                at = starts(*hit, n, m, need)
                out.append((np.full(len(at), i), at))
            rows = pa.array(np.concatenate([r for r, _ in out]) if out else np.zeros(0, np.int64))
            at = np.concatenate([a for _, a in out]) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("at").take(rows), batch.column("n").take(rows), pa.array(at.astype(np.int32))], ["doc_id", "at", "n", "start"])

    windows = shared.mapInArrow(pick, "doc_id long, at int, n int, start int").distinct()
    windows = windows.groupBy("doc_id", "at").agg(F.collect_list(F.struct("start", "n")).alias("windows"))  # of one region
    windows = stored(found.join(windows, ["doc_id", "at"]))

    def prints(batches):
        for batch in batches:
            out = []
            for doc, at, words, spans in zip(*(batch.column(c) for c in ("doc_id", "at", "words", "windows")), strict=True):
                words = words.values.to_numpy().view(np.uint64)
                for w in spans.as_py():
                    own = words[w["start"] : w["start"] + w["n"]]
                    value = simhash(own)
                    out.append((doc.as_py(), at.as_py(), w["start"], w["n"], value, signed(np.unique(shingles(own, min(SIZE, len(own)))))))
            if out:
                cols = list(zip(*out, strict=True))
                types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "at", "start", "n", "print", "runs"])

    text_batches(spark)
    windows = stored(windows.mapInArrow(prints, "doc_id long, at int, start int, n int, print long, runs array<long>"))
    block = lambda b: F.shiftright("print", 8 * b).bitwiseAND(F.lit(255)).cast("int")
    index = items.select("item_id", "n", F.col("print").alias("item_print"), F.explode(F.array(*[F.struct(F.lit(b).alias("block"), block(b).bitwiseXOR(F.lit(v)).alias("value")) for b in range(BLOCKS) for v in [0, *(1 << j for j in range(8))]])).alias("key"))
    index = index.select("item_id", "n", "item_print", "key.block", "key.value")
    probes = windows.select("doc_id", "at", "start", "n", "print", F.posexplode(F.array(*[block(b) for b in range(BLOCKS)])).alias("block", "value"))
    near = probes.join(index, ["n", "block", "value"]).filter(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    near = near.select("doc_id", "at", "start", "n", "item_id").distinct()
    known = known.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("run", "weight"))).alias("weights"))
    pairs = near.join(windows.select("doc_id", "at", "start", "n", "runs"), ["doc_id", "at", "start", "n"]).join(known, "item_id")
    both = F.aggregate("runs", F.lit(0.0), lambda s, x: s + F.coalesce(F.col("weights")[x], F.lit(0.0)))
    other = F.size(F.filter("runs", lambda x: ~F.map_contains_key("weights", x))) * float(np.log(1 + (total or 0)))
    whole = F.aggregate(F.map_values("weights"), F.lit(0.0), lambda s, x: s + x)
    pairs = pairs.withColumn("similarity", both / (whole + other)).filter(F.col("similarity") >= similarity)
    best = F.max(F.struct("similarity", (-(F.col("at") + F.col("start"))).alias("place"), "n")).alias("best")
    return pairs.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("best.place")).cast("long").alias("start_word"), F.col("best.n").cast("long").alias("n_words"), F.col("best.similarity").alias("similarity"))


def decontaminate(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without those that hold a window like an item."""
    found = find(docs, items, similarity).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
