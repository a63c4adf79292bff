"""Postings in blocks of row ids, and the best rows of queries without scoring all blocks (block-max).

A block of a term holds its occurrences in ``ROWS`` row ids, with what bounds their scores: the most occurrences in each column and
the least length of a row. Blocks of all terms cover the same row ids, so the bounds of a query's words add up to a bound
of each block of rows. A first pass reads bounds only, takes the blocks with the highest ones, and scores the fewest of them that hold k rows:
the k-th best is a threshold. A second pass scores the other blocks whose bound reaches it. A row lies in one block, so scores are exact and
the rows are those of scoring everything; bounds hold whatever the weights (if none is negative), the lengths and the frequencies are meanwhile.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import tokens
from quarry.operators.search import BLOCK, CELLS, FEW_TERMS, K1, B, few

#: Row ids of a block (fixed value), and tokens that a task gathers at once.
ROWS = 1024
TOKENS = 2_000_000
#: ``rows``: row ids less those of earlier blocks. ``tf``: the first column's counts of all rows, then the next one's. ``positions``: of each count, in its order.
SCHEMA = "term string, block long, n long, max_tf array<int>, min_len long, rows array<int>, lens array<int>, tf array<int>, positions array<int>"
#: Decimals of a score, so that equal rows tie in whatever order their parts were summed; bounds have as much to spare.
DECIMALS = 9
SPARE = 10.0**-DECIMALS


def block_of(row_id: Column) -> Column:
    return F.floor(row_id / ROWS).cast("long")


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values.astype(np.int32)))


def _gathered(numbers: np.ndarray, lengths: np.ndarray, cells: pa.ListArray, block: int, n_columns: int, size: int) -> pa.RecordBatch:
    """The block's rows (their numbers, lengths, and tokens by row and column) by term."""
    per_cell = pc.list_value_length(cells).to_numpy()
    words = pc.list_flatten(cells).dictionary_encode()
    cell, n_rows, n_terms = np.repeat(np.arange(len(per_cell)), per_cell), len(numbers), len(words.dictionary)
    place = np.arange(len(cell)) - np.repeat(np.cumsum(per_cell) - per_cell, per_cell)
    code = words.indices.to_numpy().astype(np.int64)
    key = (code * n_columns + cell % n_columns) * n_rows + cell // n_columns
    order = np.argsort(key, kind="stable")
    key, tf = np.unique(key[order], return_counts=True)
    entries, of_key = np.unique(key // n_rows // n_columns * n_rows + key % n_rows, return_inverse=True)
    term, row = entries // n_rows, entries % n_rows
    n = np.bincount(term, minlength=n_terms)
    first = np.cumsum(n) - n
    own, column = key // n_rows // n_columns, key // n_rows % n_columns
    counts = np.zeros(len(entries) * n_columns, np.int64)
    counts[first[own] * n_columns + column * n[own] + of_key - first[own]] = tf
    starts = (first[:, None] * n_columns + np.arange(n_columns) * n[:, None]).reshape(-1)
    columns = [
        words.dictionary, pa.array(np.full(n_terms, block)), pa.array(n), _lists(np.maximum.reduceat(counts, starts), np.full(n_terms, n_columns)), pa.array(np.minimum.reduceat(lengths[row], first)),
        _lists(numbers[row] - block * size, n), _lists(lengths[row], n), _lists(counts, n * n_columns), _lists(place[order], np.bincount(code, minlength=n_terms)),
    ]
    return pa.RecordBatch.from_arrays(columns, ["term", "block", "n", "max_tf", "min_len", "rows", "lens", "tf", "positions"])


def postings(chunks: DataFrame, columns: list[str]) -> DataFrame:
    """Blocks of the text columns of chunks (row_id, doc_len, columns...), sorted by term within each task.

    Rows that are read together lie in the same block, so a block is made where they are read, and nothing is shuffled. A block whose rows
    are read by two tasks comes in two parts, which changes no score: entries, frequencies and bounds add up.
    """
    size, n_columns = ROWS, len(columns)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, lengths = batch.column("row_id").to_numpy(), batch.column("doc_len").to_numpy()
            # a part ends with its block, or where it would have too many tokens
            part = np.cumsum(np.diff(numbers // size, prepend=-1) != 0) * (len(numbers) + lengths.sum() // TOKENS + 1) + np.cumsum(lengths) // TOKENS
            cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(numbers))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                cells = pc.list_flatten(batch.column("words").slice(lo, hi - lo))
                if lengths[lo:hi].any():
                    yield _gathered(numbers[lo:hi], lengths[lo:hi], cells, int(numbers[lo]) // size, n_columns, size)

    rows = chunks.select("row_id", F.col("doc_len").cast("long").alias("doc_len"), F.array(*[tokens(F.col(c)) for c in columns]).alias("words"))
    return rows.mapInArrow(gather, SCHEMA).sortWithinPartitions("term", "block")


def frequencies(blocks: DataFrame, sign: int = 1) -> DataFrame:
    """(term, df): in how many rows each term stands, times ``sign``."""
    return blocks.groupBy("term").agg((sign * F.sum("n")).cast("long").alias("df"))


def word_rows(chunks: DataFrame, columns: list[str], sign: int = 1) -> DataFrame:
    """(term, df) as of ``frequencies``, of chunks that needn't have postings."""
    words = F.array_distinct(F.flatten(F.array(*[tokens(F.col(c)) for c in columns])))
    return chunks.select(F.explode(words).alias("term")).groupBy("term").agg((sign * F.count("*")).cast("long").alias("df"))


def bitmaps(rows: DataFrame) -> DataFrame:
    """(bucket, bitmap) of row ids: a bit for each of 32768 ids."""
    bit = F.bitmap_construct_agg(F.bitmap_bit_position("row_id"))
    return rows.groupBy(F.bitmap_bucket_number("row_id").alias("bucket")).agg(bit.alias("bitmap"))


def _marked(rows: DataFrame, bitmaps: DataFrame) -> tuple[DataFrame, Column]:
    """Rows with their bitmap, and whether their bit is set. A bitmap takes a bit for each row id, so all go to all tasks and rows stay where they are."""
    whole = bitmaps.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    marked = rows.withColumn("bucket", F.bitmap_bucket_number("row_id")).join(F.broadcast(whole), "bucket", "left")
    at = F.bitmap_bit_position("row_id")
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return marked, F.coalesce(F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1, F.lit(False))


def live(rows: DataFrame, deleted: DataFrame | None) -> DataFrame:
    """Rows (row_id, ...) whose bit isn't set in ``deleted`` (bucket, bitmap), which may have several bitmaps of a bucket."""
    if deleted is None:
        return rows
    marked, gone = _marked(rows, deleted)
    return marked.filter(~gone).select(rows.columns)


def among(rows: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Rows (row_id, ...) whose bit is set."""
    marked, there = _marked(rows, bitmaps)
    return marked.filter(there).select(rows.columns)


@dataclass
class Corpus:
    """What scores need of all rows: blocks, document frequencies (term, df), deleted row ids or None, and totals."""

    blocks: DataFrame
    frequency: DataFrame
    deleted: DataFrame | None
    n_rows: int
    n_tokens: int

    def idf(self, df: Column) -> Column:
        return F.greatest(F.log((self.n_rows - df + 0.5) / (df + 0.5)), F.lit(1e-6))

    def part(self, idf: Column, f: Column, length: Column) -> Column:
        """What a word adds to a row's score."""
        average = self.n_tokens / max(self.n_rows, 1) or 1.0
        return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * length / average))


def _weighted(tf: Column, weights: list[float]) -> Column:
    return sum((F.lit(float(w)) * tf[i] for i, w in enumerate(weights)), F.lit(0.0))


def _row_id(row: Column) -> Column:
    return (F.col("block") * ROWS + row).alias("row_id")


def _phrases(corpus: Corpus, words: DataFrame, weights: list[float]) -> DataFrame:
    """(query_id, pos, block, row_id, f, doc_len) of the rows in which a phrase's terms stand next to each other in a column."""
    cells = F.flatten(F.transform("tf", lambda n, cell: F.array_repeat(cell, n)))  # of each position
    rows = corpus.blocks.select("term", "block", "n", "rows", "lens", "tf", "positions").join(words, "term")
    rows = rows.select("query_id", "pos", "offset", "size", "block", "n", "rows", "lens", F.explode(F.arrays_zip(cells.alias("cell"), F.col("positions").alias("place"))).alias("e"))
    at = (F.col("e.cell") % F.col("n")).cast("int")
    starts = rows.select("query_id", "pos", "size", "block", _row_id(F.col("rows")[at]), F.col("lens")[at].cast("long").alias("doc_len"), F.floor(F.col("e.cell") / F.col("n")).cast("int").alias("c"), (F.col("e.place") - F.col("offset")).alias("start"))
    starts = live(starts, corpus.deleted)
    whole = starts.groupBy("query_id", "pos", "size", "block", "row_id", "doc_len", "c", "start").agg(F.count("*").alias("n")).filter("n = size")
    weight = F.array(*[F.lit(float(w)) for w in weights])[F.col("c")]
    return whole.groupBy("query_id", "pos", "block", "row_id", "doc_len").agg(F.sum(weight).alias("f"))


def _near(corpus: Corpus, words: DataFrame, weights: list[float], k: int) -> tuple[DataFrame, DataFrame] | None:
    """``top`` of words of one term, without shuffling a row of each (query, row) pair: postings of the query terms are dealt by blocks, and a task gives the k best rows of each
    query in its blocks. None if there are too many terms or queries for a table of them."""
    asked = words.filter("size = 1 and term is not null").groupBy("query_id", "term").agg(F.count("*").alias("n")).limit(CELLS // 10 + 1).toArrow().combine_chunks()
    ids, terms = (asked[c].unique() for c in ("query_id", "term"))
    if not len(ids) or len(terms) > FEW_TERMS or len(ids) * max(len(terms), k) > CELLS or asked.num_rows > CELLS // 10:
        return None
    known, n_queries, n_columns, size = terms.to_pylist(), len(ids), len(weights), ROWS
    df = {r.term: r.df for r in corpus.frequency.filter(F.col("term").isin(known)).groupBy("term").agg(F.sum("df").alias("df")).collect()}
    df = np.array([df.get(t, 0) for t in known], float)
    idf = np.maximum(np.log((corpus.n_rows - df + 0.5) / (df + 0.5)), 1e-6) * (K1 + 1)
    times = np.zeros((len(known), n_queries))
    times[pc.index_in(asked["term"], value_set=terms).to_numpy(), pc.index_in(asked["query_id"], value_set=ids).to_numpy()] = asked["n"].to_numpy()
    weight, average = np.array(weights, float), corpus.n_tokens / max(corpus.n_rows, 1) or 1.0
    own = corpus.blocks.filter(F.col("term").isin(known))

    def part(code: np.ndarray, f: np.ndarray, length: np.ndarray) -> np.ndarray:
        return np.maximum(idf[code] * f / (f + K1 * (1 - B + B * length / average)), 1e-300)  # above nothing also where all weights are zero

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bounds of each query's words in blocks, of which a task has most together."""
        for batch in batches:
            code = pc.index_in(batch.column("term"), value_set=terms).to_numpy()
            block, of_block = np.unique(batch.column("block").to_numpy(), return_inverse=True)
            most = pc.list_flatten(batch.column("max_tf")).to_numpy().reshape(-1, n_columns) @ weight
            parts, n, order = part(code, most, batch.column("min_len").to_numpy()), batch.column("n").to_numpy(), np.argsort(of_block, kind="stable")
            for i, at in enumerate(np.split(order, np.flatnonzero(np.diff(of_block[order])) + 1)):
                bound, q = parts[at] @ times[code[at]], np.flatnonzero(times[code[at]].any(0))
                held = np.array([n[at[times[code[at], x] > 0]].max() for x in q]) if len(q) else q
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.full(len(q), block[i])), pa.array(held), pa.array(bound[q])], ["q", "block", "n", "bound"])

    bounds = own.select("term", "block", "n", "max_tf", "min_len").mapInArrow(bounded, "q long, block long, n long, bound double")
    bounds = bounds.groupBy("q", "block").agg(F.max("n").alias("n"), F.sum("bound").alias("bound"))
    best = Window.partitionBy("q").orderBy(F.desc("bound"), "block")
    first = bounds.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= k)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("q").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen: dict[int, list[int]] = {}
    for r in first.withColumn("before", before).filter(F.col("before") < k).select("q", "block").collect():
        chosen.setdefault(r.block, []).append(r.q)
    least = np.zeros(n_queries)

    def scores(blocks: DataFrame, alone: bool) -> DataFrame:
        """(q, row_id, points) of the k best rows of each query, and (q, null, null, blocks, scored); ``alone``: in the chosen blocks only, else in all whose bounds reach ``least`` too."""
        rows = blocks.select("term", "block", "max_tf", "min_len", "rows", "lens", "tf")
        if corpus.deleted is not None:
            buckets = corpus.deleted.select("bucket").distinct().select(F.explode(F.sequence((F.col("bucket") - 1) * 32768 + 1, F.col("bucket") * 32768)).alias("row_id"))
            gone = among(buckets, corpus.deleted).groupBy(block_of(F.col("row_id")).alias("block")).agg(F.collect_list((F.col("row_id") % size).cast("int")).alias("rows"))
            rows = rows.unionByName(gone, allowMissingColumns=True)
        numbers = {b: np.array(q) for b, q in chosen.items()}

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low, kept = least.copy(), [np.zeros(0, np.int64)] * 3  # query, points, row
            work = np.zeros((2, n_queries), np.int64)

            def prune() -> None:
                nonlocal kept
                at = np.lexsort((kept[2], kept[1], kept[0]))
                q, points, row = (x[at] for x in kept)
                start = np.flatnonzero(np.diff(q, prepend=-1))
                place = np.arange(len(q)) - np.repeat(start, np.diff(start, append=len(q)))
                last = place == k - 1
                low[q[last]] = np.maximum(low[q[last]], (-points[last] - 1) * SPARE)
                kept = [x[place < k] for x in (q, points, row)]

            def block(parts: list[pa.RecordBatch]) -> None:
                nonlocal kept
                table = pa.Table.from_batches(parts)
                number = table["block"][0].as_py()
                gone = table.filter(pc.is_null(table["term"]))["rows"].combine_chunks()
                table = table.filter(pc.is_valid(table["term"])).combine_chunks()
                if not table.num_rows:
                    return
                col = {c: pc.list_flatten(table[c].combine_chunks()).to_numpy() for c in ("max_tf", "rows", "lens", "tf")}
                code = pc.index_in(table["term"], value_set=terms).to_numpy()
                n = pc.list_value_length(table["rows"]).to_numpy()
                bound = part(code, col["max_tf"].reshape(-1, n_columns) @ weight, table["min_len"].to_numpy()) @ times[code]
                there = bound > 0
                of_first = np.zeros(n_queries, bool)
                of_first[numbers.get(number, [])] = True
                own = np.flatnonzero(of_first if alone else there & (of_first | (bound * (1 + SPARE) + SPARE >= least)))
                work[0] += there
                work[1, own] += 1
                if not len(own):
                    return
                start = np.repeat(np.cumsum(n) - n, n)
                at = start * (n_columns - 1) + np.arange(len(start))  # the first column's count of each entry
                f = sum(w * col["tf"][at + c * np.repeat(n, n)] for c, w in enumerate(weight))
                entry, row = np.repeat(code, n), col["rows"].astype(np.int64)
                value = part(entry, f, col["lens"])
                if len(gone):
                    alive = ~np.isin(row, pc.list_flatten(gone).to_numpy())
                    entry, row, value = entry[alive], row[alive], value[alive]
                order = np.argsort(row, kind="stable")
                entry, row, value = entry[order], row[order], value[order]
                used, of_term = np.unique(entry, return_inverse=True)
                step = max(1, BLOCK // max(len(used), len(own)))
                for lo in range(0, size, step):
                    here = slice(*np.searchsorted(row, [lo, lo + step]))
                    if here.start == here.stop:
                        continue
                    cells = np.zeros((step, len(used)))
                    cells[row[here] - lo, of_term[here]] = value[here]
                    sums = cells @ times[np.ix_(used, own)]
                    r, q = np.nonzero(sums >= np.maximum(low[own], 1e-305))
                    points = -np.floor(sums[r, q] / SPARE + 0.5).astype(np.int64)
                    kept = [np.concatenate(x) for x in zip(kept, (own[q], points, number * size + lo + r), strict=True)]
                    if len(kept[0]) > 4 * k * n_queries:
                        prune()

            held: list[pa.RecordBatch] = []
            for batch in batches:
                at = batch.column("block").to_numpy()
                cuts = np.append(np.flatnonzero(np.diff(at, prepend=-1)), len(at))
                for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                    if held and held[0].column("block")[0].as_py() != at[lo]:
                        block(held)
                        held = []
                    held.append(batch.slice(lo, hi - lo))
            if held:
                block(held)
            if len(kept[0]):
                prune()
            q, points, row = kept
            names = ["q", "row_id", "points", "blocks", "scored"]
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(row), pa.array(points), pa.nulls(len(q), pa.int64()), pa.nulls(len(q), pa.int64())], names)
            q = np.flatnonzero(work[0])
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.nulls(len(q), pa.int64()), pa.nulls(len(q), pa.int64()), pa.array(work[0, q]), pa.array(work[1, q])], names)

        return rows.repartition("block").sortWithinPartitions("block").mapInArrow(near, "q long, row_id long, points long, blocks long, scored long")

    order = Window.partitionBy("q").orderBy("points", "row_id")
    ranked = lambda rows: rows.filter("row_id is not null").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    spark = words.sparkSession
    if chosen:
        only = F.broadcast(spark.createDataFrame([(b,) for b in chosen], "block long"))
        for r in ranked(scores(own.join(only, "block", "left_semi"), True)).filter(F.col("rank") == k).select("q", "points").collect():
            least[r.q] = (-r.points - 1) * SPARE
    done = scores(own, False)
    names = F.broadcast(spark.createDataFrame([(i, x) for i, x in enumerate(ids.to_pylist())], T.StructType([T.StructField("q", T.LongType()), words.schema["query_id"]])))
    found = ranked(done).join(names, "q").select("query_id", "row_id", (F.col("points") / 1e9).alias("score"))
    work = done.filter("row_id is null").groupBy("q").agg(F.sum("blocks").alias("blocks"), F.sum("scored").alias("scored"))
    return found, work.join(names, "q").select("query_id", "blocks", "scored")


def top(corpus: Corpus, words: DataFrame, weights: list[float], k: int, phrases: bool = True) -> tuple[DataFrame, DataFrame]:
    """(scores, work): (query_id, row_id, score), lower is better, of the k best rows of each query, ties by row id; and what it took, (query_id, blocks, scored).

    words: (query_id, term, pos, offset, size); a word of one term has size 1. Without ``phrases`` all have. A term that a query repeats counts again.
    """
    if not phrases and all(w >= 0 for w in weights):
        found = _near(corpus, words, weights, k)
        if found:
            return found
    single = words.filter("size = 1").select("query_id", "term", "pos")
    df = corpus.frequency.join(few(single.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    single = few(single.join(df, "term").select("query_id", "term", "pos", corpus.idf(F.col("df")).alias("idf")))
    bounds = corpus.blocks.select("term", "block", "n", "max_tf", "min_len").join(single, "term")
    bounds = bounds.select("query_id", "block", "n", corpus.part(F.col("idf"), _weighted(F.col("max_tf"), weights), F.col("min_len")).alias("bound"))
    exact = None
    if phrases:
        hits = _phrases(corpus, few(words.filter("size > 1")), weights)
        seen = hits.groupBy("query_id", "pos").agg(F.count("*").alias("df"))
        exact = hits.join(seen, ["query_id", "pos"]).select("query_id", "block", "row_id", corpus.part(corpus.idf(F.col("df")), F.col("f"), F.col("doc_len")).alias("part"))
        rows = exact.groupBy("query_id", "block", "row_id").agg(F.sum("part").alias("part"))  # of all phrases of a query
        bounds = bounds.unionByName(rows.groupBy("query_id", "block").agg(F.count("*").alias("n"), F.max("part").alias("bound")))
    safe = all(w >= 0 for w in weights)
    bounds = bounds.groupBy("query_id", "block").agg(F.max("n").alias("n"), (F.sum("bound") if safe else F.lit(float("inf"))).alias("bound"))

    def scored(chosen: DataFrame) -> DataFrame:
        chosen = chosen.select("query_id", "block")
        rows = corpus.blocks.select("term", "block", "n", "rows", "lens", "tf").join(single, "term").join(chosen, ["query_id", "block"], "left_semi")
        rows = rows.select("query_id", "idf", "block", "n", "lens", "tf", F.posexplode("rows").alias("i", "row"))
        counts = F.array(*[F.col("tf")[(c * F.col("n") + F.col("i")).cast("int")] for c in range(len(weights))])
        rows = live(rows.select("query_id", "idf", _row_id(F.col("row")), F.col("lens")[F.col("i")].alias("doc_len"), counts.alias("tf")), corpus.deleted)
        parts = rows.select("query_id", "row_id", corpus.part(F.col("idf"), _weighted(F.col("tf"), weights), F.col("doc_len")).alias("part"))
        if exact is not None:
            parts = parts.unionByName(exact.join(chosen, ["query_id", "block"], "left_semi").drop("block"))
        return parts.groupBy("query_id", "row_id").agg(F.round(-F.sum("part"), DECIMALS).alias("score"))

    # a block holds a row at least, so the first k by bound hold k rows; Spark takes the best of each task before it shuffles
    best = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    first = bounds.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= k)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("query_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = first.withColumn("before", before).filter(F.col("before") < k).select("query_id", "block")
    order = Window.partitionBy("query_id").orderBy("score", "row_id")
    kept = scored(first).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    limit = kept.filter(F.col("rank") == k).select("query_id", (-F.col("score")).alias("limit"))
    rest = bounds.join(first, ["query_id", "block"], "left_anti").join(limit, "query_id", "left")
    rest = rest.filter(F.col("limit").isNull() | (F.col("bound") * (1 + SPARE) + SPARE >= F.col("limit")))
    both = kept.drop("rank").unionByName(scored(rest))
    found = both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank")
    chosen = first.unionByName(rest.select("query_id", "block")).groupBy("query_id").agg(F.count("*").alias("scored"))
    work = bounds.groupBy("query_id").agg(F.count("*").alias("blocks")).join(chosen, "query_id")
    return found, work
