"""Registered queries over the test tables, and the same as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import character_cost, query_terms, query_words, token_cost, tokens
from quarry.functions.hashes import content_hash
from quarry.operators import formats, maintain, metrics, search, segment
from quarry.sources import records

TEXT = "the ingestion of the nd threwh"
PHRASES = "of_the ingestion threwh"
COLUMNS, WEIGHTS = ["symbol_name", "text"], [10.0, 1.0]


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: the first line is the name, source and language make the path."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat_ws("", F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select(F.col("doc_id").alias("row_id"), F.split("text", "\n", 2)[0].alias("symbol_name"), "text", path.alias("file_path"), "lang", "source", F.lit(0).cast("long").alias("start_byte"), F.octet_length("text").cast("long").alias("end_byte"))


CHUNKS = r"""WITH chunks AS (SELECT doc_id AS row_id, split_part(text, chr(10), 1) AS symbol_name, text,
  concat('/', source, '/', lang, '/', CAST(doc_id AS VARCHAR), '.txt') AS file_path, lang, source, CAST(strlen(text) AS BIGINT) AS end_byte FROM documents)"""
TOK = r"regexp_extract_all(strip_accents(lower({})), '[\p{{L}}\p{{N}}]+')"


def _queries_of(spark: SparkSession, texts: dict[int, str]) -> DataFrame:
    rows = [(q, t, i) for q, text in texts.items() for i, t in enumerate(query_terms(text))]
    return spark.createDataFrame(rows, "query_id long, term string, pos int")


def _benchmark_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item as a query of its distinct terms."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return items.select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).withColumn("pos", F.xxhash64("term"))


def _rounded(scores: DataFrame) -> DataFrame:
    return scores.withColumn("score", F.round(F.col("score") * 1e6).cast("long"))


def token_stats(spark, sf_dir):
    c = chunks(spark, sf_dir).select("row_id", F.transform(F.array(tokens(F.col("text"))), lambda t: F.struct(F.size(t).alias("n"), F.size(F.array_distinct(t)).alias("d")))[0].alias("t"), token_cost(F.col("text")).alias("cost"))
    return c.select("row_id", F.col("t.n").cast("long").alias("n_tokens"), F.col("t.d").cast("long").alias("n_distinct"), "cost")


def character_costs(spark, sf_dir):
    """Estimated tokens of documents by characters and by bytes."""
    return chunks(spark, sf_dir).select("row_id", character_cost(F.col("text")).alias("by_characters"), token_cost(F.col("text")).alias("by_bytes"))


def doc_freq(spark, sf_dir):
    index = search.postings(chunks(spark, sf_dir), ["text"])
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def corpus_stats(spark, sf_dir):
    return search.corpus_stats(search.lengths(chunks(spark, sf_dir), COLUMNS))


def _ranked(spark, sf_dir, queries, columns, weights, k):
    return search.best(chunks(spark, sf_dir), columns, queries, {"": weights or [1.0] * len(columns)}, k).drop("config")


def bm25_topk(spark, sf_dir):
    return _ranked(spark, sf_dir, _queries_of(spark, {0: TEXT}), ["text"], None, 20).select("row_id", "score", "rank")


def bm25_weighted(spark, sf_dir):
    return _ranked(spark, sf_dir, _queries_of(spark, {0: TEXT}), COLUMNS, WEIGHTS, 20).select("row_id", "score", "rank")


def bm25_batch(spark, sf_dir):
    return _ranked(spark, sf_dir, _benchmark_terms(spark, sf_dir), ["text"], None, 5).select("query_id", "row_id", "score", "rank")


def _bm25_sql(queries: str, columns: list[str], weights: list[float], k: int, out: str) -> str:
    words = " UNION ALL ".join(f"SELECT row_id, {w} AS w, unnest({TOK.format(c)}) AS term FROM chunks" for c, w in zip(columns, weights, strict=True))
    return rf"""{CHUNKS}, t AS ({words}), q AS ({queries}),
n AS (SELECT count(*) AS n FROM chunks), l AS (SELECT row_id, count(*) AS len FROM t GROUP BY row_id), a AS (SELECT sum(len) AS total FROM l),
h AS (SELECT query_id, pos, row_id, sum(w) AS f FROM t JOIN q ON t.term = q.term GROUP BY ALL),
d AS (SELECT query_id, pos, count(*) AS df FROM h GROUP BY ALL),
s AS (SELECT h.query_id, h.row_id, CAST(round(-sum(greatest(ln((n.n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / (a.total / n.n)))) * 1e6) AS BIGINT) AS score
  FROM h JOIN d ON h.query_id = d.query_id AND h.pos = d.pos JOIN l ON h.row_id = l.row_id, n, a GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, row_id) AS INTEGER) AS rank FROM s)
SELECT {out} FROM r WHERE rank <= {k}"""


_ONE = " UNION ALL ".join(f"SELECT 0 AS query_id, '{t}' AS term, {i} AS pos" for i, t in enumerate(query_terms(TEXT)))
_MANY = f"SELECT DISTINCT item_id AS query_id, term, term AS pos FROM (SELECT item_id, unnest({TOK.format('text')}) AS term FROM benchmark)"


def phrase_match(spark, sf_dir):
    return search.phrase_rows(chunks(spark, sf_dir), "text", ["of", "the"])


def glob_filter(spark, sf_dir):
    return search.filter_paths(chunks(spark, sf_dir), ["/src1/**", "fr/*5.txt"]).select("row_id", "file_path")


def path_outline(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return c.filter(formats.under(F.col("file_path"), "/src1")).select("file_path", "symbol_name", "start_byte", "end_byte")


def budget_pack(spark, sf_dir):
    """The best rows of every benchmark item within 4000 tokens."""
    ranked = _ranked(spark, sf_dir, _benchmark_terms(spark, sf_dir), ["text"], None, 20)
    texts = chunks(spark, sf_dir).select("row_id", "text")
    return search.pack(ranked.join(texts, "row_id"), 4000).select("query_id", "row_id", "rank", "tokens", "running")


def overlap_dedup(spark, sf_dir):
    """Windows of documents, ranked by a hash within each source and language, less those that cross a better one."""
    c = chunks(spark, sf_dir).withColumn("at", F.explode(F.expr("sequence(0L, end_byte, 700L)")))
    spans = c.select(F.col("row_id").alias("query_id"), (F.col("at") / 700).cast("int").alias("row_id"), "file_path", F.col("at").alias("start_byte"), (F.col("at") + 400 + F.col("at") % 600).alias("end_byte"))
    spans = spans.withColumn("rank", F.crc32(F.concat_ws(":", "file_path", F.col("row_id").cast("string")).cast("binary")) % 1000).withColumn("rank", F.col("rank") * 1000 + F.col("row_id"))
    return search.drop_overlaps(spans)


def _snapshots(spark, sf_dir):
    """Files of two scans: in the second some are changed, some gone, some can't be read, some are new."""
    c = chunks(spark, sf_dir).select("file_path", "row_id", F.md5(F.col("text").cast("binary")).alias("hash"))
    old = c.filter("row_id % 10 <> 9").select("file_path", "hash")
    new = c.filter("row_id % 10 <> 1").select("file_path", F.when(F.col("row_id") % 10 == 2, F.concat("hash", F.lit("x"))).when(F.col("row_id") % 10 != 3, F.col("hash")).alias("hash"))
    return old, new


SNAPSHOTS = CHUNKS + r""", c AS (SELECT file_path, row_id, md5(text) AS hash FROM chunks),
o AS (SELECT file_path, hash FROM c WHERE row_id % 10 <> 9),
n AS (SELECT file_path, CASE WHEN row_id % 10 = 2 THEN concat(hash, 'x') WHEN row_id % 10 <> 3 THEN hash END AS hash FROM c WHERE row_id % 10 <> 1)"""


def change_detect(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return maintain.changed(new, old)


def reconcile_deletes(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return maintain.gone(new, old)


def upsert_merge(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return maintain.merge(old, new)


def status_by_language(spark, sf_dir):
    return chunks(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n_files"), F.sum("end_byte").alias("n_bytes"))


def _gold(spark, sf_dir):
    """Gold rows of a benchmark item: documents that hold its text.

    Rows and items are joined on the item's first four tokens (all, if it has fewer). A row keeps only its runs of words that begin an
    item, unless there are many items, and is compared where it lies. Items without tokens have no gold.
    """
    first = lambda words, size: F.array_join(F.slice(words, 1, size), " ")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("item_text"), tokens(F.col("text")).alias("w"))
    items = items.select("query_id", "item_text", F.least(F.size("w"), F.lit(4)).alias("n"), first("w", 4).alias("key")).filter("n > 0")
    heads = items.select("n", "key").distinct().limit(search.FEW_TERMS + 1).collect()
    few = len(heads) <= search.FEW_TERMS
    sizes = sorted({r.n for r in heads} if few else {r.n for r in items.select("n").distinct().collect()})  # at most four
    rows = chunks(spark, sf_dir).select("row_id", "text", tokens(F.col("text")).alias("w"))
    runs = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))).otherwise(F.array().cast("array<string>"))
    every = F.concat(*map(runs, sizes)) if sizes else F.array().cast("array<string>")
    if few:
        own = rows.select("row_id", "text", F.explode(F.array_distinct(F.filter(every, lambda r: r.isin([h.key for h in heads])))).alias("key"))
        found = own.join(F.broadcast(items), "key")
    else:
        pairs = rows.select("row_id", F.explode(F.array_distinct(every)).alias("key")).join(items, "key").select("query_id", "item_text", "row_id").distinct()
        found = pairs.join(chunks(spark, sf_dir).select("row_id", "text"), "row_id")
    return found.filter(F.contains("text", "item_text")).select("query_id", F.col("row_id").alias("item")).distinct()


def ranking_quality(spark, sf_dir):
    """Recall, precision, F1 and NDCG at 1, 5 and 10 of BM25 for every benchmark item."""
    ranked = _ranked(spark, sf_dir, _benchmark_terms(spark, sf_dir), ["text"], None, 10).select("query_id", "rank", F.col("row_id").alias("item"))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"))
    rows = metrics.at_k(ranked, _gold(spark, sf_dir), items, [1, 5, 10])
    return rows.select("query_id", "k", *[F.round(F.col(c) * 1e6).cast("long").alias(c) for c in ("recall", "precision", "f1", "ndcg")])


def turns_to_coverage(spark, sf_dir):
    """Turns of a conversation surface their distinct words; gold: the words of the first turn that have ten letters or more."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("task"), "turn", token_cost(F.col("text")).alias("tokens"), F.array_distinct(tokens(F.col("text"))).alias("items"))
    gold = turns.filter("turn = 0").select("task", F.explode("items").alias("item")).filter("length(item) >= 10")
    return metrics.coverage(turns.filter("turn > 0"), gold, 0.5)


def offset_synthesis(spark, sf_dir):
    """Byte places of lines."""
    return segment.lines(chunks(spark, sf_dir)).select("row_id", "line", "start_byte", "end_byte")


def line_segments(spark, sf_dir):
    """Segments of documents from each line that starts with a letter of A to M."""
    return segment.by_header(chunks(spark, sf_dir), "^[A-M]")


def locator_format(spark, sf_dir):
    return chunks(spark, sf_dir).select(F.format_string("%s:%d-%d", "file_path", F.lit(1), F.size(F.split("text", "\n", -1))).alias("locator"))


#: Weights of name and text in a sweep, after the named vectors of the seven-column grid (fixed values).
GRID = {"default": [10.0, 1.0], "flat": [1.0, 1.0], "name_only": [10.0, 0.0], "body_heavy": [1.0, 10.0], "name_strong": [20.0, 1.0]}


def weight_sweep(spark, sf_dir):
    """The five best rows of every benchmark item under each weight vector."""
    return search.best(chunks(spark, sf_dir), COLUMNS, _benchmark_terms(spark, sf_dir), GRID, 5).select("config", "query_id", "row_id", "score", "rank")


def _packed(spark, sf_dir):
    """The best rows of every benchmark item within 4000 tokens, as results, and the queries with what was found."""
    ranked = _ranked(spark, sf_dir, _benchmark_terms(spark, sf_dir), ["text"], None, 20)
    c = chunks(spark, sf_dir).withColumn("start_line", F.lit(1)).withColumn("end_line", F.size(F.split("text", "\n", -1)))
    rows = search.pack(ranked.join(c, "row_id"), 4000).withColumn("score", F.col("score") / 1e6)
    rows = rows.withColumn("symbol_type", F.lit("function")).withColumn("parent_symbol", F.col("source")).withColumn("language", F.col("lang"))
    found = ranked.groupBy("query_id").agg(F.count("*").alias("found"))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return rows, items.join(found, "query_id", "left").fillna(0, ["found"])


def text_format(spark, sf_dir):
    return formats.as_text(*_packed(spark, sf_dir))


def json_format(spark, sf_dir):
    return formats.as_json(*_packed(spark, sf_dir))


def locator_lists(spark, sf_dir):
    return formats.as_locators(*_packed(spark, sf_dir))


def outline_budget(spark, sf_dir):
    c = chunks(spark, sf_dir).withColumn("start_line", F.lit(1)).withColumn("end_line", F.size(F.split("text", "\n", -1)))
    rows = c.withColumn("symbol_type", F.lit("function")).withColumn("parent_symbol", F.col("lang")).withColumn("symbol_name", F.col("source"))
    return formats.outline(rows, "/src1", 800)


def content_hashes(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return c.select("row_id", content_hash(F.col("text").cast("binary")).alias("hash"))


def phrase_query(spark, sf_dir):
    """The best rows for the words ``of_the`` (a phrase), ``ingestion`` and ``threwh``."""
    rows = [(0, t, p, i, len(w)) for p, w in enumerate(query_words(PHRASES)) for i, t in enumerate(w)]
    asked = spark.createDataFrame(rows, "query_id long, term string, pos int, offset int, size int")
    c = chunks(spark, sf_dir)
    scores = search.bm25(search.postings(c, COLUMNS, positions=True, queries=asked), search.lengths(c, COLUMNS), asked, WEIGHTS)
    return search.top_k(_rounded(scores), 20).select("row_id", "score", "rank")


def search_filtered(spark, sf_dir):
    """The 20 best rows of every benchmark item, of these those of French or German files, packed into 4000 tokens."""
    scores = _ranked(spark, sf_dir, _benchmark_terms(spark, sf_dir), ["text"], None, 20).drop("rank")
    packed, found = search.retrieve(scores, chunks(spark, sf_dir), 20, 4000, ["/*/fr/**", "de/*.txt"])
    return packed.join(found, "query_id").select("query_id", "row_id", "rank", "tokens", "running", "found")


def benchmark_records(spark, sf_dir):
    """Records made of documents (a file with its lines as gold; some null, broken or with odd elements), read back."""
    c = chunks(spark, sf_dir)
    gold = F.to_json(F.array(F.struct(F.col("file_path").alias("file"), F.lit(1).alias("start_line"), F.size(F.split("text", "\n", -1)).alias("end_line"))))
    odd = F.concat(F.lit('[3, null, {"file": 5}, '), F.substring(gold, F.lit(2), F.length(gold)))
    kind = F.col("row_id") % 5
    context = F.when(kind == 1, F.lit("[{")).when(kind == 2, odd).when(kind != 3, gold)
    rows = records.benchmark_queries(c.select(F.col("row_id").cast("string").alias("instance_id"), F.col("source").alias("repo"), F.col("symbol_name").alias("problem_statement"), context.alias("gold_context")))
    return rows.select("corpus_id", "query_id", "query", F.array_join(F.transform("gold_blocks", lambda b: b["symbol_name"]), ",").alias("blocks"), F.array_join("gold_files", ",").alias("files"))


def task_selection(spark, sf_dir):
    """The first 15 documents in French or German of the first three sources."""
    c = chunks(spark, sf_dir).select(F.col("source").alias("repo"), F.col("row_id").alias("instance_id"), F.col("lang").alias("language"))
    return records.select_tasks(c, 3, 15, ("fr", "de"))


def size_segments(spark, sf_dir):
    return segment.by_size(chunks(spark, sf_dir), 300)


def _line_chunks(spark, sf_dir):
    c = chunks(spark, sf_dir)
    rows = segment.lines(c).join(c.select("row_id", "file_path", "source"), "row_id")
    return rows.select(F.col("source").alias("corpus_id"), "file_path", F.col("line").alias("place"), F.col("line_text").alias("chunk_text"))


def chunk_places(spark, sf_dir):
    """Bytes and lines of chunks that are known by their order only."""
    return segment.places(_line_chunks(spark, sf_dir)).select("file_path", "place", "start_byte", "end_byte", "start_line", "end_line")


def file_texts(spark, sf_dir):
    """Files put together from their chunks."""
    return segment.join_files(_line_chunks(spark, sf_dir))


def _turns(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("task"), "turn", token_cost(F.col("text")).alias("tokens"), F.array_distinct(tokens(F.col("text"))).alias("items"))
    return turns.filter("turn > 0"), turns.filter("turn = 0").select("task", F.explode("items").alias("item")).filter("length(item) >= 10")


def surfaced_lists(spark, sf_dir):
    """The words of each conversation after its first turn, first seen first."""
    return metrics.surfaced_lists(_turns(spark, sf_dir)[0])


def trajectory_quality(spark, sf_dir):
    """How well the words of later turns cover the long words of the first one, and when."""
    rows = metrics.trajectories(*_turns(spark, sf_dir), [1, 5, 10], 0.5)
    return rows.select("query_id", "k", "turn", "tokens", *[F.round(F.col(c) * 1e6).cast("long").alias(c) for c in ("recall", "precision", "f1", "ndcg")])


def macro_quality(spark, sf_dir):
    """Means of the measures over the benchmark items."""
    rows = metrics.macro(ranking_quality(spark, sf_dir))
    return rows.select("k", *[F.round(c, 3).alias(c) for c in ("recall", "precision", "f1", "ndcg")])


def weighted_arms(spark, sf_dir):
    """Mean bytes and lines of documents by language, from the means by language and source weighted by their documents."""
    c = chunks(spark, sf_dir).withColumn("lines", F.size(F.split("text", "\n", -1)))
    parts = c.groupBy(F.col("lang").alias("arm"), "source").agg(F.count("*").alias("n_queries"), F.avg("end_byte").alias("bytes"), F.avg("lines").alias("lines"))
    rows = metrics.weighted(parts, ["bytes", "lines"], ["arm"])
    return rows.select("arm", "n_queries", F.round("bytes", 3).alias("bytes"), F.round("lines", 3).alias("lines"))


def ingest_totals(spark, sf_dir):
    """For each source the language of its first document, and its documents."""
    return chunks(spark, sf_dir).groupBy("source").agg(F.min_by("lang", "row_id").alias("language"), F.count("*").alias("chunk_count"))


def ablation_report(spark, sf_dir):
    """The quality of each weight vector for all benchmark items, as a Markdown report; the arms are the best rows kept: 1 or 5."""
    ranked = weight_sweep(spark, sf_dir).select("config", "query_id", "rank", F.col("row_id").alias("item")).withColumn("query_id", F.struct("config", "query_id"))
    names = F.explode(F.array(*map(F.lit, GRID))).alias("config")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id")).select("query_id", names)
    gold = _gold(spark, sf_dir).select("query_id", "item", names)
    pair = lambda df: df.withColumn("query_id", F.struct("config", "query_id")).drop("config")
    scores = metrics.at_k(ranked.drop("config"), pair(gold), pair(items), [1, 5]).withColumn("config", F.col("query_id.config"))
    means = scores.groupBy("config", "k").agg(F.avg("f1").alias("f1"), F.avg("ndcg").alias("ndcg"), F.count("*").alias("n_queries"))
    order, weights = F.lit(0), F.lit("")
    for i, (name, ws) in enumerate(GRID.items()):
        order, weights = F.when(F.col("config") == name, i).otherwise(order), F.when(F.col("config") == name, ",".join(f"{w:g}" for w in ws)).otherwise(weights)
    configs = means.withColumns({"ord": order, "weights": weights})
    arms = means.filter("config = 'default'").select(F.concat(F.lit("best "), "k").alias("arm"), F.col("k").alias("ord"), "n_queries", F.lit(5).alias("k"), "f1", "ndcg")
    return formats.ablation_report(configs, arms, 5)


QUERIES = {
    f.__name__: f
    for f in (
        token_stats, character_costs, doc_freq, corpus_stats, bm25_topk, bm25_weighted, bm25_batch, phrase_match, glob_filter, path_outline, budget_pack, overlap_dedup, change_detect,
        reconcile_deletes, upsert_merge, status_by_language, ranking_quality, turns_to_coverage, offset_synthesis, line_segments, locator_format, weight_sweep, text_format, json_format, locator_lists, outline_budget, content_hashes,
        phrase_query, search_filtered, benchmark_records, task_selection, size_segments, chunk_places, file_texts, surfaced_lists, trajectory_quality, macro_quality, weighted_arms,
        ingest_totals, ablation_report,
    )
}

_T = TOK.format("text")
_LINES = CHUNKS + r""", p AS (SELECT row_id, unnest(regexp_extract_all(text, '[^\n]*\n|[^\n]+')) AS line_text, generate_subscripts(regexp_extract_all(text, '[^\n]*\n|[^\n]+'), 1) AS line FROM chunks),
e AS (SELECT row_id, CAST(line AS INTEGER) AS line, line_text, CAST(sum(strlen(line_text)) OVER (PARTITION BY row_id ORDER BY line) AS BIGINT) AS end_byte FROM p),
lines AS (SELECT row_id, line, line_text, CAST(end_byte - strlen(line_text) AS BIGINT) AS start_byte, end_byte FROM e)"""
ORACLES = {
    "token_stats": f"{CHUNKS} SELECT row_id, CAST(len({_T}) AS BIGINT) AS n_tokens, CAST(len(list_distinct({_T})) AS BIGINT) AS n_distinct, CAST(greatest(1, strlen(text) // 4) AS BIGINT) AS cost FROM chunks",
    "character_costs": f"{CHUNKS} SELECT row_id, CAST(greatest(1, length(coalesce(text, '')) // 4) AS BIGINT) AS by_characters, CAST(greatest(1, strlen(coalesce(text, '')) // 4) AS BIGINT) AS by_bytes FROM chunks",
    "doc_freq": f"WITH t AS (SELECT doc_id, unnest({_T}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term",
    "corpus_stats": f"{CHUNKS} SELECT count(*) AS n_rows, CAST(sum(len({TOK.format('symbol_name')}) + len({_T})) AS BIGINT) AS total_tokens FROM chunks",
    "bm25_topk": _bm25_sql(_ONE, ["text"], [1.0], 20, "row_id, score, rank"),
    "bm25_weighted": _bm25_sql(_ONE, COLUMNS, WEIGHTS, 20, "row_id, score, rank"),
    "bm25_batch": _bm25_sql(_MANY, ["text"], [1.0], 5, "query_id, row_id, score, rank"),
    "phrase_match": f"{CHUNKS}, w AS (SELECT row_id, unnest({_T}) AS term, generate_subscripts({_T}, 1) AS pos FROM chunks) SELECT a.row_id, count(*) AS n FROM w a JOIN w b ON a.row_id = b.row_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY a.row_id",
    "glob_filter": CHUNKS + " SELECT row_id, file_path FROM chunks WHERE file_path LIKE '/src1/%' OR (lang = 'fr' AND file_path LIKE '%5.txt')",
    "path_outline": CHUNKS + " SELECT file_path, symbol_name, CAST(0 AS BIGINT) AS start_byte, end_byte FROM chunks WHERE file_path = '/src1' OR starts_with(lower(file_path), '/src1/')",
    "budget_pack": _bm25_sql(_MANY, ["text"], [1.0], 20, "query_id, row_id, rank") .replace("SELECT query_id, row_id, rank FROM r WHERE rank <= 20", """, x AS (SELECT query_id, r.row_id, rank, CAST(greatest(1, strlen(text) // 4) AS BIGINT) AS tokens FROM r JOIN chunks ON r.row_id = chunks.row_id WHERE rank <= 20),
y AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS running FROM x) SELECT * FROM y WHERE running <= 4000"""),
    "change_detect": SNAPSHOTS + " SELECT n.file_path, n.hash FROM n LEFT JOIN o ON n.file_path = o.file_path WHERE n.hash IS NULL OR o.hash IS NULL OR n.hash <> o.hash",
    "reconcile_deletes": SNAPSHOTS + " SELECT file_path, hash FROM o WHERE file_path NOT IN (SELECT file_path FROM n)",
    "upsert_merge": SNAPSHOTS + " SELECT file_path, hash FROM n UNION ALL SELECT file_path, hash FROM o WHERE file_path NOT IN (SELECT file_path FROM n)",
    "status_by_language": CHUNKS + " SELECT lang, count(*) AS n_files, CAST(sum(end_byte) AS BIGINT) AS n_bytes FROM chunks GROUP BY lang",
    "ranking_quality": _bm25_sql(_MANY, ["text"], [1.0], 10, "X").replace("SELECT X FROM r WHERE rank <= 10", """, g AS (SELECT item_id AS query_id, doc_id AS row_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
gs AS (SELECT query_id, count(*) AS g FROM g GROUP BY query_id), ks AS (SELECT unnest([1, 5, 10]) AS k),
hr AS (SELECT r.query_id, rank, CASE WHEN g.row_id IS NULL THEN 0 ELSE 1 END AS hit FROM r LEFT JOIN g ON r.query_id = g.query_id AND r.row_id = g.row_id WHERE rank <= 10),
m AS (SELECT b.item_id AS query_id, k, count(rank) AS n, coalesce(sum(CASE WHEN rank <= k THEN hit END), 0) AS h, coalesce(sum(CASE WHEN rank <= k THEN hit / log2(rank + 1.0) END), 0) AS dcg
  FROM benchmark b CROSS JOIN ks LEFT JOIN hr ON hr.query_id = b.item_id GROUP BY ALL),
v AS (SELECT m.query_id, k, dcg, coalesce(g, 0) AS g, CASE WHEN g IS NULL THEN 1.0 ELSE h / g END AS recall, CASE WHEN n = 0 THEN 0.0 ELSE h / least(k, n) END AS precision,
  (SELECT sum(1 / log2(i + 1.0)) FROM range(1, 11) t(i) WHERE i <= least(k, coalesce(g, 0))) AS ideal FROM m LEFT JOIN gs ON m.query_id = gs.query_id)
SELECT query_id, CAST(k AS INTEGER) AS k, CAST(round(recall * 1e6) AS BIGINT) AS recall, CAST(round(precision * 1e6) AS BIGINT) AS precision,
  CAST(round(CASE WHEN recall + precision = 0 THEN 0 ELSE 2 * recall * precision / (recall + precision) END * 1e6) AS BIGINT) AS f1,
  CAST(round(CASE WHEN g = 0 THEN 1.0 ELSE dcg / ideal END * 1e6) AS BIGINT) AS ndcg FROM v"""),
    "turns_to_coverage": rf"""WITH t AS (SELECT conv_id AS task, turn, CAST(greatest(1, strlen(text) // 4) AS BIGINT) AS tokens, list_distinct({_T}) AS items FROM conversations),
g AS (SELECT * FROM (SELECT DISTINCT task, unnest(items) AS item FROM t WHERE turn = 0) WHERE length(item) >= 10), gs AS (SELECT task, count(*) AS g FROM g GROUP BY task),
f AS (SELECT x.task, x.item, min(turn) AS turn FROM (SELECT task, turn, unnest(items) AS item FROM t WHERE turn > 0) x JOIN g ON x.task = g.task AND x.item = g.item GROUP BY ALL),
n AS (SELECT task, turn, count(*) AS new FROM f GROUP BY ALL),
r AS (SELECT t.task, t.turn, coalesce(g, 0) AS g, sum(coalesce(new, 0)) OVER w AS seen, CAST(sum(tokens) OVER w AS BIGINT) AS spent FROM t LEFT JOIN n ON t.task = n.task AND t.turn = n.turn LEFT JOIN gs ON t.task = gs.task WHERE t.turn > 0
  WINDOW w AS (PARTITION BY t.task ORDER BY t.turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT task, min(CASE WHEN g = 0 OR seen >= 0.5 * g THEN turn END) AS turn, min(CASE WHEN g = 0 OR seen >= 0.5 * g THEN spent END) AS tokens FROM r GROUP BY task""",
    "offset_synthesis": _LINES + " SELECT row_id, line, start_byte, end_byte FROM lines",
    "line_segments": _LINES + r", s AS (SELECT *, CAST(sum(CASE WHEN regexp_matches(line_text, '^[A-M]') THEN 1 ELSE 0 END) OVER (PARTITION BY row_id ORDER BY line) AS BIGINT) AS segment FROM lines) SELECT row_id, segment, min(line) AS start_line, max(line) AS end_line, min(start_byte) AS start_byte, max(end_byte) AS end_byte FROM s WHERE segment > 0 GROUP BY row_id, segment",
    "locator_format": CHUNKS + " SELECT concat(file_path, ':1-', CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS VARCHAR)) AS locator FROM chunks",
}

_PACKED = ORACLES["budget_pack"].replace("r.row_id, rank,", "r.row_id, rank, score, symbol_name, text, file_path, lang, source, end_byte, len(text) - len(replace(text, chr(10), '')) + 1 AS end_line,").replace("SELECT * FROM y WHERE running <= 4000", """, z AS (SELECT * FROM y WHERE running <= 4000),
fo AS (SELECT query_id, count(*) AS found FROM r WHERE rank <= 20 GROUP BY query_id), qs AS (SELECT item_id AS query_id, text AS query, coalesce(found, 0) AS found FROM benchmark LEFT JOIN fo ON item_id = fo.query_id)""")
_RULE = formats.RULE
ORACLES["text_format"] = _PACKED + f""", b AS (SELECT query_id, count(*) AS shown, sum(tokens) AS spent, string_agg(printf('[%d] %s.%s (function) %s:1-%d (score: %.2f)', rank, source, symbol_name, file_path, end_line, score / 1e6) || chr(10) || text || chr(10) || chr(10), '' ORDER BY rank) AS body FROM z GROUP BY query_id)
SELECT qs.query_id, '{_RULE}' || chr(10) || 'Query: "' || query || '"' || chr(10) || 'Found ' || found || ' results (showing top ' || coalesce(shown, 0) || ', ' || CAST(coalesce(spent, 0) AS BIGINT) || ' tokens)' || chr(10) || '{_RULE}' || chr(10) || chr(10) || coalesce(body, '') || '{_RULE}' || chr(10) AS output FROM qs LEFT JOIN b ON qs.query_id = b.query_id"""
ORACLES["locator_lists"] = _PACKED + """, b AS (SELECT query_id, string_agg(file_path || ':1-' || end_line || chr(10), '' ORDER BY rank) AS body FROM z GROUP BY query_id)
SELECT qs.query_id, coalesce(body, '') AS output FROM qs LEFT JOIN b ON qs.query_id = b.query_id"""
ORACLES["outline_budget"] = CHUNKS + """, o AS (SELECT *, row_number() OVER (ORDER BY file_path) AS n, len(text) - len(replace(text, chr(10), '')) + 1 AS end_line FROM chunks WHERE starts_with(file_path, '/src1/')),
l AS (SELECT CAST(n + 2 AS INTEGER) AS line_no, printf('[%d] %s.%s (function) %s:1-%d', n, lang, source, file_path, end_line) AS line FROM o
  UNION ALL SELECT 1, 'Path: "/src1"' UNION ALL SELECT 2, printf('Found %d symbols', (SELECT count(*) FROM o))),
w AS (SELECT *, sum(strlen(line) + 1) OVER (ORDER BY line_no) AS bytes FROM l)
SELECT line_no, line FROM w WHERE line_no <= 2 OR bytes // 4 <= 800"""
ORACLES["weight_sweep"] = " UNION ALL ".join(f"SELECT '{name}' AS config, * FROM ({_bm25_sql(_MANY, COLUMNS, ws, 5, 'query_id, row_id, score, rank')})" for name, ws in GRID.items())
ORACLES["phrase_query"] = rf"""{CHUNKS}, t AS (SELECT row_id, 0 AS c, 10.0 AS w, unnest({TOK.format("symbol_name")}) AS term, generate_subscripts({TOK.format("symbol_name")}, 1) AS at FROM chunks
  UNION ALL SELECT row_id, 1, 1.0, unnest({_T}), generate_subscripts({_T}, 1) FROM chunks),
n AS (SELECT count(*) AS n FROM chunks), l AS (SELECT row_id, count(*) AS len FROM t GROUP BY row_id), a AS (SELECT sum(len) AS total FROM l),
m AS (SELECT 0 AS pos, x.row_id, x.w FROM t x JOIN t y ON x.row_id = y.row_id AND x.c = y.c AND y.at = x.at + 1 WHERE x.term = 'of' AND y.term = 'the'
  UNION ALL SELECT 1, row_id, w FROM t WHERE term = 'ingestion' UNION ALL SELECT 2, row_id, w FROM t WHERE term = 'threwh'),
h AS (SELECT pos, row_id, sum(w) AS f FROM m GROUP BY ALL), d AS (SELECT pos, count(*) AS df FROM h GROUP BY ALL),
s AS (SELECT h.row_id, CAST(round(-sum(greatest(ln((n.n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / (a.total / n.n)))) * 1e6) AS BIGINT) AS score
  FROM h JOIN d ON h.pos = d.pos JOIN l ON h.row_id = l.row_id, n, a GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(row_number() OVER (ORDER BY score, row_id) AS INTEGER) AS rank FROM s) WHERE rank <= 20"""
ORACLES["search_filtered"] = _bm25_sql(_MANY, ["text"], [1.0], 20, "X").replace("SELECT X FROM r WHERE rank <= 20", """, x AS (SELECT query_id, r.row_id, score, source, lang, CAST(greatest(1, strlen(text) // 4) AS BIGINT) AS tokens FROM r JOIN chunks ON r.row_id = chunks.row_id WHERE rank <= 20 AND lang IN ('fr', 'de')),
y AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, source, lang, CAST(row_id AS VARCHAR) || '.txt') AS INTEGER) AS rank, count(*) OVER (PARTITION BY query_id) AS found FROM x),
z AS (SELECT query_id, row_id, rank, tokens, found, CAST(sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS running FROM y) SELECT query_id, row_id, rank, tokens, running, found FROM z WHERE running <= 4000""")
ORACLES["benchmark_records"] = CHUNKS + """ SELECT source AS corpus_id, CAST(row_id AS VARCHAR) AS query_id, symbol_name AS query, CASE WHEN row_id % 5 IN (1, 3) THEN '' ELSE file_path END AS files,
  CASE WHEN row_id % 5 IN (1, 3) THEN '' ELSE file_path || '::L1-L' || (length(text) - length(replace(text, chr(10), '')) + 1) END AS blocks FROM chunks"""
ORACLES["task_selection"] = """SELECT source AS repo, doc_id AS instance_id, lang AS language FROM documents WHERE lang IN ('fr', 'de') AND source IN (SELECT DISTINCT source FROM documents WHERE lang IN ('fr', 'de') AND source IS NOT NULL ORDER BY source LIMIT 3) ORDER BY source, doc_id LIMIT 15"""
ORACLES["size_segments"] = _LINES + r", w AS (SELECT *, coalesce(sum(length(regexp_replace(line_text, '[ \t\n\x0B\f\r]', '', 'g'))) OVER (PARTITION BY row_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lines) SELECT row_id, CAST(before // 300 AS BIGINT) AS segment, min(line) AS start_line, max(line) AS end_line, min(start_byte) AS start_byte, max(end_byte) AS end_byte FROM w GROUP BY ALL"
ORACLES["chunk_places"] = _LINES + " SELECT file_path, line AS place, start_byte, lines.end_byte, line AS start_line, line AS end_line FROM lines JOIN chunks ON lines.row_id = chunks.row_id"
ORACLES["file_texts"] = CHUNKS + " SELECT source AS corpus_id, file_path, text FROM chunks WHERE text <> ''"
_TURNS = rf"WITH t AS (SELECT conv_id AS task, turn, CAST(greatest(1, strlen(text) // 4) AS BIGINT) AS tokens, list_distinct({_T}) AS unordered, {_T} AS items FROM conversations)"
_SEEN = _TURNS + """, e AS (SELECT task, turn, unnest(items) AS item, generate_subscripts(items, 1) AS pos FROM t WHERE turn > 0),
f AS (SELECT task, item, min((turn, pos)) AS place FROM e GROUP BY ALL), s AS (SELECT task AS query_id, CAST(row_number() OVER (PARTITION BY task ORDER BY place) AS INTEGER) AS rank, item FROM f)"""
ORACLES["surfaced_lists"] = _SEEN + " SELECT query_id, rank, item FROM s"
_MEASURES = """CAST(round(recall * 1e6) AS BIGINT) AS recall, CAST(round(precision * 1e6) AS BIGINT) AS precision,
  CAST(round(CASE WHEN recall + precision = 0 THEN 0 ELSE 2 * recall * precision / (recall + precision) END * 1e6) AS BIGINT) AS f1"""
ORACLES["trajectory_quality"] = _SEEN + f""", g AS (SELECT DISTINCT task AS query_id, item FROM (SELECT task, unnest(items) AS item FROM t WHERE turn = 0) WHERE length(item) >= 10),
gs AS (SELECT query_id, count(*) AS g FROM g GROUP BY ALL), ks AS (SELECT unnest([1, 5, 10]) AS k), q AS (SELECT DISTINCT task AS query_id FROM t WHERE turn > 0),
hr AS (SELECT s.query_id, rank, CASE WHEN g.item IS NULL THEN 0 ELSE 1 END AS hit FROM s LEFT JOIN g ON s.query_id = g.query_id AND s.item = g.item),
m AS (SELECT q.query_id, k, count(rank) AS n, coalesce(sum(CASE WHEN rank <= k THEN hit END), 0) AS h, coalesce(sum(CASE WHEN rank <= k THEN hit / log2(rank + 1.0) END), 0) AS dcg FROM q CROSS JOIN ks LEFT JOIN hr ON hr.query_id = q.query_id GROUP BY ALL),
v AS (SELECT m.query_id, k, dcg, coalesce(g, 0) AS g, CASE WHEN g IS NULL THEN 1.0 ELSE h / g END AS recall, CASE WHEN n = 0 THEN 0.0 ELSE h / least(k, n) END AS precision,
  (SELECT sum(1 / log2(i + 1.0)) FROM range(1, 11) t(i) WHERE i <= least(k, coalesce(g, 0))) AS ideal FROM m LEFT JOIN gs ON m.query_id = gs.query_id),
c AS (SELECT * FROM ({ORACLES["turns_to_coverage"]}))
SELECT v.query_id, CAST(k AS INTEGER) AS k, c.turn, c.tokens, {_MEASURES}, CAST(round(CASE WHEN g = 0 THEN 1.0 ELSE dcg / ideal END * 1e6) AS BIGINT) AS ndcg FROM v JOIN c ON v.query_id = c.task"""
ORACLES["macro_quality"] = f"SELECT k, round(avg(recall), 3) AS recall, round(avg(precision), 3) AS precision, round(avg(f1), 3) AS f1, round(avg(ndcg), 3) AS ndcg FROM ({ORACLES['ranking_quality']}) GROUP BY k"
ORACLES["weighted_arms"] = CHUNKS + " SELECT lang AS arm, count(*) AS n_queries, round(avg(end_byte), 3) AS bytes, round(avg(length(text) - length(replace(text, chr(10), '')) + 1), 3) AS lines FROM chunks GROUP BY lang"
ORACLES["ingest_totals"] = "SELECT source, arg_min(lang, doc_id) AS language, count(*) AS chunk_count FROM documents GROUP BY source"
_FIELDS = {"symbol_name": "symbol_name", "symbol_type": "'function'", "file_path": "file_path", "start_byte": "0", "end_byte": "end_byte", "language": "lang", "bm25_score": "score / 1e6", "chunk_text": "text"}
_OBJECT = " || ',' || chr(10) || ".join(f"""'      "{k}": ' || to_json({v})""" for k, v in _FIELDS.items())
ORACLES["json_format"] = _PACKED + f""", b AS (SELECT query_id, sum(tokens) AS spent, string_agg('    {{' || chr(10) || {_OBJECT} || chr(10) || '    }}', ',' || chr(10) ORDER BY rank) AS body FROM z GROUP BY query_id)
SELECT qs.query_id, '{{' || chr(10) || '  "query": ' || to_json(query) || ',' || chr(10) || '  "total_results": ' || found || ',' || chr(10) || '  "total_tokens": ' || CAST(coalesce(spent, 0) AS BIGINT) || ',' || chr(10)
  || '  "chunks": ' || CASE WHEN body IS NULL THEN '[]' ELSE '[' || chr(10) || body || chr(10) || '  ]' END || chr(10) || '}}' AS output FROM qs LEFT JOIN b ON qs.query_id = b.query_id"""
_CONFIGS = " UNION ALL ".join(f"SELECT '{name}' AS config, {i} AS ord, '{','.join(f'{w:g}' for w in ws)}' AS weights" for i, (name, ws) in enumerate(GRID.items()))
ORACLES["ablation_report"] = f"""WITH w AS (SELECT * FROM ({ORACLES["weight_sweep"]})), c AS ({_CONFIGS}), ks AS (SELECT unnest([1, 5]) AS k),
g AS (SELECT DISTINCT item_id AS query_id, doc_id AS row_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE len({TOK.format("b.text")}) > 0), gs AS (SELECT query_id, count(*) AS g FROM g GROUP BY query_id),
hr AS (SELECT w.config, w.query_id, rank, CASE WHEN g.row_id IS NULL THEN 0 ELSE 1 END AS hit FROM w LEFT JOIN g ON w.query_id = g.query_id AND w.row_id = g.row_id),
m AS (SELECT c.config, b.item_id AS query_id, ks.k, count(rank) AS n, coalesce(sum(CASE WHEN rank <= ks.k THEN hit END), 0) AS h, coalesce(sum(CASE WHEN rank <= ks.k THEN hit / log2(rank + 1.0) END), 0) AS dcg
  FROM benchmark b CROSS JOIN ks CROSS JOIN c LEFT JOIN hr ON hr.query_id = b.item_id AND hr.config = c.config GROUP BY ALL),
v AS (SELECT config, m.query_id, k, dcg, coalesce(g, 0) AS g, CASE WHEN g IS NULL THEN 1.0 ELSE h / g END AS recall, CASE WHEN n = 0 THEN 0.0 ELSE h / least(k, n) END AS precision,
  (SELECT sum(1 / log2(i + 1.0)) FROM range(1, 11) t(i) WHERE i <= least(k, coalesce(gs.g, 0))) AS ideal FROM m LEFT JOIN gs ON m.query_id = gs.query_id),
a AS (SELECT config, k, count(*) AS n_queries, avg(CASE WHEN recall + precision = 0 THEN 0 ELSE 2 * recall * precision / (recall + precision) END) AS f1, avg(CASE WHEN g = 0 THEN 1.0 ELSE dcg / ideal END) AS ndcg FROM v GROUP BY ALL),
f AS (SELECT a.*, ord, weights FROM a JOIN c ON a.config = c.config WHERE k = 5),
t AS (SELECT string_agg('| ' || config || ' | ' || weights || ' | ' || printf('%.4f', f1) || ' | ' || printf('%.4f', ndcg) || ' |', chr(10) ORDER BY ord) AS rows, arg_max(config, (ndcg, -ord)) AS best, max(ndcg) AS value FROM f),
u AS (SELECT string_agg('| best ' || k || ' | ' || n_queries || ' | ' || printf('%.4f', f1) || ' | ' || printf('%.4f', ndcg) || ' |', chr(10) ORDER BY k) AS rows FROM a WHERE config = 'default')
SELECT '## Weight vectors at 5' || chr(10) || chr(10) || '| config | weights | f1 | ndcg |' || chr(10) || '|---|---|---|---|' || chr(10) || t.rows || chr(10) || chr(10)
  || '## Arms at 5' || chr(10) || chr(10) || '| arm | n_queries | f1 | ndcg |' || chr(10) || '|---|---|---|---|' || chr(10) || u.rows || chr(10) || chr(10)
  || 'Best by NDCG@5: **' || best || '** (' || printf('%.4f', value) || '); the default is the best: **' || CASE WHEN best = 'default' THEN 'yes' ELSE 'no' END || '**' AS output FROM t, u"""
