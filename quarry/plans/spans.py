"""Registered queries on spans, places and arms, and the same as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators import intervals, metrics, search, segment
from quarry.plans.queries import _LINES, _MANY, CHUNKS, TOK, _benchmark_terms, _bm25_sql, _gold, chunks


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of documents: all of it, segments from each line that begins with A to F, and within them from each with A to M."""
    c = chunks(spark, sf_dir)
    whole = c.filter("end_byte > 0").select("row_id", F.lit("whole").alias("id"), F.lit(0).cast("long").alias("start"), F.col("end_byte").alias("end"))
    for name, header in (("outer", "^[A-F]"), ("inner", "^[A-M]")):
        parts = segment.by_header(c, header)
        whole = whole.unionByName(parts.select("row_id", F.format_string(f"{name} %d", "segment").alias("id"), F.col("start_byte").alias("start"), F.col("end_byte").alias("end")))
    return whole


def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the middle byte of every line the innermost segment that holds it."""
    lines = segment.lines(chunks(spark, sf_dir)).select("row_id", "line", F.floor((F.col("start_byte") + F.col("end_byte")) / 2).alias("at"))
    return intervals.containing(lines, _nested(spark, sf_dir), "row_id", 4096)


def overlap_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of documents by their hash, in one list for each language, less those that cross or equal a better one of their document."""
    c = chunks(spark, sf_dir).withColumn("at", F.explode(F.expr("sequence(0L, end_byte, 97L)")))
    spans = c.select(F.col("lang").alias("query_id"), "file_path", F.col("at").alias("start_byte"), (F.col("at") + 150 + F.col("at") % 600).alias("end_byte"), "row_id")
    spans = spans.withColumn("rank", F.conv(F.substring(F.md5(F.concat_ws(":", "file_path", F.col("start_byte").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long"))
    return intervals.drop_overlaps(spans).select("query_id", "row_id", "start_byte", "end_byte")


def chunk_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without their ends, some marked, so that they aren't there, looked for in their documents one after the other."""
    c = chunks(spark, sf_dir)
    lines = segment.lines(c).withColumn("chunk_text", F.regexp_replace("line_text", "\n$", ""))
    own = F.when(F.col("line") % 5 == 3, F.concat(F.lit("~"), "chunk_text")).otherwise(F.col("chunk_text"))
    lines = lines.select(F.col("row_id").cast("string").alias("file_path"), F.col("line").alias("place"), F.col("line").alias("start_line"), own.alias("chunk_text"))
    found = segment.align(lines, c.select(F.col("row_id").cast("string").alias("file_path"), "text"))
    return found.select("file_path", "place", "start_byte", "end_byte", "verbatim")


def _arms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(chunks, gold) of two arms: documents whole, and cut at lines; a part belongs to its document, which is the gold."""
    c = chunks(spark, sf_dir)
    parts = segment.lines(c).select(F.lit("lines").alias("arm"), (F.col("row_id") * 100_000 + F.col("line")).alias("row_id"), F.col("row_id").alias("doc_id"), F.col("line_text").alias("text"))
    whole = c.select(F.lit("whole").alias("arm"), (F.col("row_id") * 100_000).alias("row_id"), F.col("row_id").alias("doc_id"), "text")
    return whole.unionByName(parts), _gold(spark, sf_dir)


def _arm_ranks(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    rows, _ = _arms(spark, sf_dir)
    return search.best(rows, ["text"], _benchmark_terms(spark, sf_dir), {"": [1.0]}, k, ("arm",)).drop("config")


def arm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows of every benchmark item in each arm, by the arm's own statistics."""
    return _arm_ranks(spark, sf_dir, 5).select("arm", "query_id", "row_id", "score", "rank")


def arm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arms side by side: how well each finds the documents that hold the items; of several parts of a document the best counts."""
    best = _arm_ranks(spark, sf_dir, 20).withColumn("item", F.floor(F.col("row_id") / 100_000)).groupBy("arm", "query_id", "item").agg(F.min("rank").alias("rank"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("arm", "query_id").orderBy("rank")))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"))
    rows = search.side_by_side(ranked, _gold(spark, sf_dir), items, ["whole", "lines"], [1, 5])
    return rows.select("arm", "k", "n_queries", *[F.round(c, 4).alias(c) for c in ("recall", "precision", "f1", "ndcg")])


#: The seven columns of a chunk as parts of a document (Spark, DuckDB), and the six weight vectors (fixed values).
_LINE = "split_part(text, chr(10), {})"
_COLUMNS = {
    "symbol_name": ("symbol_name", "symbol_name"), "symbol_type": ("lang", "lang"), "chunk_text": ("text", "text"), "parent_symbol": ("source", "source"),
    "imports": (_LINE.format(2), _LINE.format(2)), "cross_references": (_LINE.format(3), _LINE.format(3)), "file_docstring": (_LINE.format(4), _LINE.format(4)),
}
VECTORS = {
    "default": [10, 1, 1, 5, 2, 2, 2], "flat": [1, 1, 1, 1, 1, 1, 1], "name_only": [10, 0, 0, 0, 0, 0, 0],
    "body_heavy": [1, 1, 10, 1, 1, 1, 1], "name_strong": [20, 1, 1, 5, 2, 2, 2], "enrich_heavy": [10, 1, 1, 5, 5, 5, 5],
}


def sweep_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six weight vectors over seven columns: means of all measures of files (folders) and blocks (documents), over all items and those taken as keyword queries."""
    c = chunks(spark, sf_dir)
    rows = c.select("row_id", *[F.expr(e).alias(n) for n, (e, _) in _COLUMNS.items()])
    folder = F.concat_ws("/", "source", "lang").alias("file_path")
    best = search.best(rows, list(_COLUMNS), _benchmark_terms(spark, sf_dir), VECTORS, 10).join(c.select("row_id", folder), "row_id")
    pair = lambda df: df.withColumn("query_id", F.struct("config", "query_id")).drop("config")
    every = F.explode(F.array(*map(F.lit, VECTORS))).alias("config")
    gold = _gold(spark, sf_dir).select("query_id", "item", every)
    files = gold.join(c.select(F.col("row_id").alias("item"), folder), "item").select("query_id", F.col("file_path").alias("item"), "config")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 3 == 0, "semantic").otherwise("keyword").alias("query_type")).select("*", every)
    found = metrics.at_levels(pair(best.withColumnRenamed("row_id", "item")), pair(files), pair(gold), pair(items).select("query_id"), [1, 10])
    means = metrics.macro_levels(found.withColumn("config", F.col("query_id.config")), pair(items), ("config",))
    return means.select("config", "subset", "k", "n_queries", *[F.round(m, 4).alias(m) for m in metrics.LEVELS])


QUERIES = {f.__name__: f for f in (containment, overlap_rounds, chunk_alignment, arm_scores, arm_quality, sweep_grid)}

_BYTES = "array_to_string([chr(256 + CAST('0x' || substr({0}, 2 * i + 1, 2) AS INTEGER)) FOR i IN range(length({0}) // 2)], '')"
_PART = "SELECT row_id, '{0} ' || segment AS id, min(start_byte) AS start, max(end_byte) AS stop FROM (SELECT *, CAST(sum(CASE WHEN regexp_matches(line_text, '{1}') THEN 1 ELSE 0 END) OVER (PARTITION BY row_id ORDER BY line) AS BIGINT) AS segment FROM lines) WHERE segment > 0 GROUP BY row_id, segment"
_ARM_SQL = rf"""{_LINES}, rows AS (SELECT 'whole' AS arm, row_id * 100000 AS row_id, row_id AS doc_id, text FROM chunks UNION ALL SELECT 'lines', row_id * 100000 + line, row_id, line_text FROM lines),
q AS ({_MANY}), t AS (SELECT arm, row_id, unnest({TOK.format("text")}) AS term FROM rows), n AS (SELECT arm, count(*) AS n FROM rows GROUP BY arm),
l AS (SELECT arm, row_id, count(*) AS len FROM t GROUP BY ALL), a AS (SELECT l.arm, sum(len) / any_value(n) AS average, any_value(n) AS n FROM l JOIN n ON l.arm = n.arm GROUP BY l.arm),
h AS (SELECT arm, query_id, pos, row_id, count(*) AS f FROM t JOIN q ON t.term = q.term GROUP BY ALL), d AS (SELECT arm, query_id, pos, count(*) AS df FROM h GROUP BY ALL),
s AS (SELECT h.arm, h.query_id, h.row_id, CAST(round(-sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / average))) * 1e6) AS BIGINT) AS score
  FROM h JOIN d ON h.arm = d.arm AND h.query_id = d.query_id AND h.pos = d.pos JOIN l ON h.arm = l.arm AND h.row_id = l.row_id JOIN a ON h.arm = a.arm GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY arm, query_id ORDER BY score, row_id) AS INTEGER) AS rank FROM s)"""
ORACLES = {
    "containment": f"""{_LINES}, spans AS (SELECT row_id, 'whole' AS id, 0 AS start, end_byte AS stop FROM chunks WHERE end_byte > 0 UNION ALL {_PART.format("outer", "^[A-F]")} UNION ALL {_PART.format("inner", "^[A-M]")}),
pts AS (SELECT row_id, line, CAST((start_byte + end_byte) // 2 AS BIGINT) AS place_at FROM lines),
x AS (SELECT pts.row_id, line, place_at, CAST(start AS BIGINT) AS span_start, CAST(stop AS BIGINT) AS span_end, id AS span_id, row_number() OVER (PARTITION BY pts.row_id, line ORDER BY start DESC, stop, id) AS n
  FROM pts LEFT JOIN spans ON pts.row_id = spans.row_id AND place_at BETWEEN start AND stop - 1)
SELECT row_id, line, place_at AS "at", span_start, span_end, span_id FROM x WHERE n = 1""",
    "chunk_alignment": f"""{_LINES.replace("WITH", "WITH RECURSIVE", 1)}, b AS (SELECT row_id, {_BYTES.format("h")} AS data FROM (SELECT row_id, hex(encode(text)) AS h FROM chunks)),
w AS (SELECT row_id, line, start_byte AS place_at, CASE WHEN line % 5 = 3 THEN '~' || own ELSE own END AS own FROM (SELECT *, regexp_replace(line_text, '\n$', '') AS own FROM lines)),
c AS (SELECT row_id, line, place_at, {_BYTES.format("h")} AS own FROM (SELECT *, hex(encode(own)) AS h FROM w)),
g AS (SELECT row_id, 0 AS place, CAST(0 AS BIGINT) AS start_byte, CAST(0 AS BIGINT) AS end_byte, false AS verbatim FROM b
  UNION ALL SELECT row_id, line, start, start + size, hit > 0 FROM (SELECT *, CAST(CASE WHEN hit > 0 THEN goes_on + hit - 1 ELSE place_at END AS BIGINT) AS start
    FROM (SELECT c.row_id, c.line, c.place_at, length(own) AS size, g.end_byte AS goes_on, CASE WHEN own <> '' THEN instr(substr(data, g.end_byte + 1), own) WHEN g.end_byte <= length(data) THEN 1 ELSE 0 END AS hit
      FROM g JOIN c ON g.row_id = c.row_id AND c.line = g.place + 1 JOIN b ON g.row_id = b.row_id)))
SELECT CAST(row_id AS VARCHAR) AS file_path, place, start_byte, end_byte, verbatim FROM g WHERE place > 0""",
    "arm_scores": f"{_ARM_SQL} SELECT arm, query_id, row_id, score, rank FROM r WHERE rank <= 5",
}

_GREEDY = """o AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY rank) AS i FROM spans),
k AS (SELECT file_path, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(s BIGINT, e BIGINT)[]) AS kept, false AS stays FROM (SELECT DISTINCT file_path FROM o)
  UNION ALL SELECT file_path, i, CASE WHEN bad THEN kept ELSE list_append(kept, {'s': s, 'e': e}) END, NOT bad FROM (SELECT k.file_path, o.i, kept, start_byte AS s, end_byte AS e,
    len(list_filter(kept, lambda x: (x.s = start_byte AND x.e = end_byte) OR (x.s < start_byte AND start_byte < x.e AND x.e < end_byte) OR (start_byte < x.s AND x.s < end_byte AND end_byte < x.e))) > 0 AS bad
    FROM k JOIN o ON k.file_path = o.file_path AND o.i = k.i + 1))"""
ORACLES["overlap_rounds"] = f"""{CHUNKS.replace("WITH", "WITH RECURSIVE", 1)}, c AS (SELECT row_id, lang, file_path, unnest(range(0, end_byte + 1, 97)) AS place_at FROM chunks),
spans AS (SELECT lang AS query_id, row_id, file_path, CAST(place_at AS BIGINT) AS start_byte, CAST(place_at + 150 + place_at % 600 AS BIGINT) AS end_byte, CAST('0x' || substr(md5(file_path || ':' || place_at), 1, 8) AS BIGINT) AS rank FROM c), {_GREEDY}
SELECT query_id, row_id, start_byte, end_byte FROM o JOIN k ON o.file_path = k.file_path AND o.i = k.i WHERE stays"""
_BITS = "xor(x, CASE WHEN k % 8 = 0 THEN ascii(id[k // 8 + 1]) ELSE 0 END)"
#: crc32 of the text ``id``, bit by bit.
_CRC = f"xor(list_reduce(range(0, 8 * length(id)), lambda x, k: xor({_BITS} >> 1, CASE WHEN {_BITS} % 2 = 1 THEN 3988292384 ELSE 0 END), 4294967295), 4294967295)"
ORACLES["overlap_dedup"] = f"""{CHUNKS.replace("WITH", "WITH RECURSIVE", 1)}, c AS (SELECT row_id AS doc, file_path, unnest(range(0, end_byte + 1, 700)) AS place_at FROM chunks),
n AS (SELECT *, place_at // 700 AS row_id, file_path || ':' || (place_at // 700) AS id FROM c),
spans AS (SELECT doc, row_id, file_path, CAST(place_at AS BIGINT) AS start_byte, CAST(place_at + 400 + place_at % 600 AS BIGINT) AS end_byte, {_CRC} % 1000 * 1000 + row_id AS rank FROM n), {_GREEDY}
SELECT doc AS query_id, CAST(rank AS INTEGER) AS rank, row_id, o.file_path, start_byte, end_byte FROM o JOIN k ON o.file_path = k.file_path AND o.i = k.i WHERE stays"""
ORACLES["arm_quality"] = f"""{_ARM_SQL}, best AS (SELECT arm, query_id, row_id // 100000 AS item, min(rank) AS first FROM r WHERE rank <= 20 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY arm, query_id ORDER BY first) AS rank FROM best),
g AS (SELECT DISTINCT item_id AS query_id, doc_id AS item FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE len({TOK.format("b.text")}) > 0), gs AS (SELECT query_id, count(*) AS g FROM g GROUP BY query_id),
hr AS (SELECT k.arm, k.query_id, rank, CASE WHEN g.item IS NULL THEN 0 ELSE 1 END AS hit FROM k LEFT JOIN g ON k.query_id = g.query_id AND k.item = g.item),
m AS (SELECT a.arm, b.item_id AS query_id, ks.k, count(rank) AS n, coalesce(sum(CASE WHEN rank <= ks.k THEN hit END), 0) AS h, coalesce(sum(CASE WHEN rank <= ks.k THEN hit / log2(rank + 1.0) END), 0) AS dcg
  FROM benchmark b CROSS JOIN (SELECT unnest([1, 5]) AS k) ks CROSS JOIN (SELECT unnest(['whole', 'lines']) AS arm) a LEFT JOIN hr ON hr.query_id = b.item_id AND hr.arm = a.arm GROUP BY ALL),
v AS (SELECT m.*, coalesce(g, 0) AS g, CASE WHEN g IS NULL THEN 1.0 ELSE h / g END AS recall, CASE WHEN n = 0 THEN 0.0 ELSE h / least(k, n) END AS precision,
  (SELECT sum(1 / log2(i + 1.0)) FROM range(1, 11) t(i) WHERE i <= least(k, coalesce(gs.g, 0))) AS ideal FROM m LEFT JOIN gs ON m.query_id = gs.query_id)
SELECT arm, CAST(k AS INTEGER) AS k, count(*) AS n_queries, round(avg(recall), 4) AS recall, round(avg(precision), 4) AS precision,
  round(avg(CASE WHEN recall + precision = 0 THEN 0 ELSE 2 * recall * precision / (recall + precision) END), 4) AS f1, round(avg(CASE WHEN g = 0 THEN 1.0 ELSE dcg / ideal END), 4) AS ndcg FROM v GROUP BY arm, k"""

_LEVEL = """CASE WHEN {0}g IS NULL THEN 1.0 ELSE {0}h / {0}g END AS {0}recall, CASE WHEN {0}n = 0 THEN 0.0 ELSE {0}h / least(k, {0}n) END AS {0}precision,
  CASE WHEN {0}g IS NULL THEN 1.0 ELSE {0}dcg / (SELECT sum(1 / log2(i + 1.0)) FROM range(1, 11) t(i) WHERE i <= least(k, {0}g)) END AS {0}ndcg"""
_HITS = "count({0}rank) AS {0}n, coalesce(sum(CASE WHEN {0}rank <= k THEN {0}hit END), 0) AS {0}h, coalesce(sum(CASE WHEN {0}rank <= k THEN {0}hit / log2({0}rank + 1.0) END), 0) AS {0}dcg"
_F1 = "CASE WHEN {0}recall + {0}precision = 0 THEN 0 ELSE 2 * {0}recall * {0}precision / ({0}recall + {0}precision) END"
_SWEPT = " UNION ALL ".join(f"SELECT '{name}' AS config, * FROM ({_bm25_sql(_MANY, [d for _, d in _COLUMNS.values()], ws, 10, 'query_id, row_id, rank')})" for name, ws in VECTORS.items())
_MEANS = ", ".join(f"round(avg({_F1.format(p) if m == 'f1' else p + m}), 4) AS {level}_{m}" for level, p in (("file", "f"), ("block", "b")) for m in metrics.MEASURES)
ORACLES["sweep_grid"] = f"""WITH w AS (SELECT s.*, concat(source, '/', lang) AS folder FROM ({_SWEPT}) s JOIN documents ON row_id = doc_id),
g AS (SELECT DISTINCT item_id AS query_id, doc_id AS row_id, concat(d.source, '/', d.lang) AS folder FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE len({TOK.format("b.text")}) > 0),
gf AS (SELECT DISTINCT query_id, folder FROM g), ng AS (SELECT query_id, count(*) AS bg FROM g GROUP BY query_id), nf AS (SELECT query_id, count(*) AS fg FROM gf GROUP BY query_id),
f0 AS (SELECT config, query_id, folder, min(rank) AS first FROM w GROUP BY ALL), f1 AS (SELECT *, row_number() OVER (PARTITION BY config, query_id ORDER BY first) AS rank FROM f0),
hb AS (SELECT w.config, w.query_id, rank AS brank, CASE WHEN g.row_id IS NULL THEN 0 ELSE 1 END AS bhit FROM w LEFT JOIN g ON w.query_id = g.query_id AND w.row_id = g.row_id),
hf AS (SELECT f1.config, f1.query_id, rank AS frank, CASE WHEN gf.folder IS NULL THEN 0 ELSE 1 END AS fhit FROM f1 LEFT JOIN gf ON f1.query_id = gf.query_id AND f1.folder = gf.folder),
q AS (SELECT item_id AS query_id, k, config FROM benchmark CROSS JOIN (SELECT unnest([1, 10]) AS k) CROSS JOIN (SELECT unnest([{", ".join(f"'{n}'" for n in VECTORS)}]) AS config)),
mb AS (SELECT q.config, q.query_id, k, {_HITS.format("b")} FROM q LEFT JOIN hb ON q.config = hb.config AND q.query_id = hb.query_id GROUP BY ALL),
mf AS (SELECT q.config, q.query_id, k, {_HITS.format("f")} FROM q LEFT JOIN hf ON q.config = hf.config AND q.query_id = hf.query_id GROUP BY ALL),
m AS (SELECT mb.*, fn, fh, fdcg, bg, fg FROM mb JOIN mf ON mb.config = mf.config AND mb.query_id = mf.query_id AND mb.k = mf.k LEFT JOIN ng ON mb.query_id = ng.query_id LEFT JOIN nf ON mb.query_id = nf.query_id),
v AS (SELECT config, query_id, k, {_LEVEL.format("b")}, {_LEVEL.format("f")} FROM m),
x AS (SELECT *, unnest(CASE WHEN query_id % 3 = 0 THEN ['all'] ELSE ['all', 'keyword'] END) AS subset FROM v)
SELECT config, subset, CAST(k AS INTEGER) AS k, count(*) AS n_queries, {_MEANS} FROM x GROUP BY config, subset, k"""
