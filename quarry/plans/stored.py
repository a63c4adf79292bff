"""Registered queries on an index that is built of the test tables, and the same as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.app import LISTS, Index
from quarry.functions.text import tokens
from quarry.plans.queries import _MANY, CHUNKS, COLUMNS, TOK, WEIGHTS, _bm25_sql, chunks
from quarry.sources import records
from quarry.sources.tables import SCHEMAS, scratch


def rows(spark: SparkSession, sf_dir: str, text: Column | str = "text") -> DataFrame:
    """Documents as chunks of an index, a file each, in order of their ids."""
    c = chunks(spark, sf_dir).withColumns({"file_path": F.format_string("/%012d.txt", "row_id"), "language": F.col("lang"), "chunk_text": F.expr(text) if isinstance(text, str) else text, "start_line": F.lit(1), "end_line": F.size(F.split("text", "\n", -1))})
    c = c.withColumns({x: F.array().cast("array<string>") for x in LISTS}).withColumns({x: F.lit(None).cast("string") for x in ("symbol_type", "parent_symbol", "file_docstring")}).withColumn("is_heuristic", F.lit(False))
    names = [x.name for x in spark.createDataFrame([], SCHEMAS["chunks"]).schema]
    return c.select(F.col("row_id").alias("doc_id"), *[x for x in names if x not in ("row_id", "doc_len")])


def _put(index: Index, docs: DataFrame, drop: DataFrame | None = None) -> None:
    index.put(docs.drop("doc_id"), drop)


def built(spark: SparkSession, sf_dir: str) -> Index:
    index = Index(spark, scratch(spark))
    index.create()
    _put(index, rows(spark, sf_dir))
    return index


def kept_up(spark: SparkSession, sf_dir: str) -> Index:
    """An index that has seen all: some documents in an older form, put right later, some dropped, some late, some put again; merged on the way."""
    index, own = Index(spark, scratch(spark)), F.col("doc_id") % 10
    index.create()
    old = rows(spark, sf_dir, F.when(F.col("row_id") % 10 == 2, F.concat("text", F.lit(" ingestion of nothing"))).otherwise(F.col("text")))
    _put(index, old.filter(own != 9))
    docs = rows(spark, sf_dir)
    _put(index, docs.filter(own == 2), docs.filter(own == 1))
    _put(index, docs.filter(own == 9))
    _put(index, docs.filter(own == 3))
    return index


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item as a query of its distinct terms."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    terms = items.select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    return terms.select("query_id", "term", F.xxhash64("term").alias("pos"), F.lit(0).alias("offset"), F.lit(1).alias("size"))


def _best(index: Index, asked: DataFrame, k: int) -> DataFrame:
    found, _ = index.rank(asked, k, phrases=False)
    places = index.tables.rows("chunks", index.latest()).select("row_id", F.regexp_extract("file_path", r"\d+", 0).cast("long").alias("doc_id"))
    units = F.round(F.col("score") * 1e9).cast("long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "row_id")))
    return ranked.join(places, "row_id").select("query_id", "doc_id", F.round(units / 1000).cast("long").alias("score"), "rank")


def index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item, by blocks of a new index."""
    return _best(built(spark, sf_dir), words(spark, sf_dir), 20)


def index_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of every benchmark item, in an index after changes and merges."""
    return _best(kept_up(spark, sf_dir), words(spark, sf_dir), 10)


def index_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequencies as sums of their changes, with the totals of the version."""
    index = kept_up(spark, sf_dir)
    last = index.latest()
    return index.tables.rows("terms", last).groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0").select("term", "df", F.lit(last.n_rows).cast("long").alias("n_rows"), F.lit(last.n_tokens).cast("long").alias("n_tokens"))


def array_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON arrays and read back by splits."""
    path = scratch(spark)
    docs = rows(spark, sf_dir).withColumns({"language": F.lit("python"), "symbol_type": F.lit("function")})
    records.dump_chunks(docs.filter("chunk_text is not null"), path)
    return records.read_chunks(spark, path).select("file_path", "symbol_name", "end_byte", F.md5(F.col("chunk_text").cast("binary")).alias("hash"))


def pattern_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which benchmark items stand in which documents, and which of their first letters."""
    texts = chunks(spark, sf_dir).select(F.lit("all").alias("task"), F.col("row_id").alias("id"), "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.lit("all").alias("task"), F.explode(F.array("text", F.substring("text", 1, 14), F.substring("text", 1, 2))).alias("pattern"))
    return records.contained(texts, items).select("id", "pattern")


QUERIES = {f.__name__: f for f in (index_topk, index_upkeep, index_frequencies, array_chunks, pattern_matches)}


def _ranked_sql(k: int, order: str) -> str:
    sql = _bm25_sql(_MANY, COLUMNS, WEIGHTS, k, "query_id, row_id AS doc_id, CAST(round(score / 1000) AS BIGINT) AS score, rank")
    return sql.replace("* 1e6) AS BIGINT) AS score", "* 1e9) AS BIGINT) AS score").replace("ORDER BY score, row_id", f"ORDER BY score, {order}")


_LATE = "CASE row_id % 10 WHEN 2 THEN 1 WHEN 9 THEN 2 WHEN 3 THEN 3 ELSE 0 END, row_id"
ORACLES = {
    "array_chunks": CHUNKS + " SELECT printf('/%012d.txt', row_id) AS file_path, symbol_name, end_byte, md5(text) AS hash FROM chunks WHERE text IS NOT NULL",
    "pattern_matches": """WITH p AS (SELECT DISTINCT unnest([text, substr(text, 1, 14), substr(text, 1, 2)]) AS pattern FROM benchmark) SELECT doc_id AS id, pattern FROM documents JOIN p ON contains(text, pattern)""",
    "index_topk": _ranked_sql(20, "row_id"),
    "index_upkeep": _ranked_sql(10, _LATE).replace("FROM documents)", "FROM documents WHERE doc_id % 10 <> 1)"),
    "index_frequencies": f"""WITH w AS (SELECT doc_id, unnest(list_concat({TOK.format("split_part(text, chr(10), 1)")}, {TOK.format("text")})) AS term FROM documents WHERE doc_id % 10 <> 1)
SELECT term, count(DISTINCT doc_id) AS df, (SELECT count(*) FROM documents WHERE doc_id % 10 <> 1) AS n_rows, (SELECT count(*) FROM w) AS n_tokens FROM w GROUP BY term""",
}
