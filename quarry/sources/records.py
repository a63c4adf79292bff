"""Readers of JSON records: chunks cut elsewhere, suites of queries, benchmark records, trajectories.

Arrays of chunks are read by splits; a suite is one record of a file. Numbers in text fields are taken as text.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.search import FEW_TERMS, MANY_TERMS
from quarry.sources.arrays import read_array
from quarry.sources.files import LANGUAGES

KINDS = ["function", "class", "method", "struct"]
REQUIRED = "symbol_name string, symbol_type string, file_path string, start_byte long, end_byte long, start_line int, end_line int, chunk_text string, language string"
OPTIONAL = "parent_symbol string, file_docstring string, imports array<string>, cross_references array<string>, is_heuristic boolean"
_CHUNK = "file_path string, symbol_name string, symbol_type string, language string, chunk_text string, imports array<string>, cross_references array<string>"
_QUERY = "id string, query string, query_type string, note string, gold_files array<string>, gold_blocks array<struct<file_path: string, symbol_name: string>>"
SUITE = f"corpora array<struct<id: string, description: string, chunks: array<struct<{_CHUNK}>>, queries: array<struct<{_QUERY}>>>>"
#: Bytes between the made-up places of a suite's chunks (fixed value).
STEP = 10_000


class IngestError(ValueError):
    """Chunks that can't be read, lack a field, or hold an unknown value."""


def check_chunks(rows: DataFrame) -> DataFrame:
    """Chunks with defaults for what may be missing; the job fails at a chunk that lacks a field or has an unknown kind or language."""
    need = [c.split()[0] for c in REQUIRED.split(", ")]
    missing = F.concat_ws(", ", *[F.when(F.col(c).isNull(), c) for c in need])
    fault = F.when(missing != "", F.concat(F.lit("missing field: "), missing))
    fault = fault.when(~F.col("symbol_type").isin(KINDS), F.concat(F.lit("unknown symbol type: "), "symbol_type"))
    fault = fault.when(~F.col("language").isin(list(LANGUAGES.values())), F.concat(F.lit("unknown language: "), "language"))
    rows = rows.withColumn("symbol_name", F.when(fault.isNotNull(), F.raise_error(fault)).otherwise(F.col("symbol_name")))
    empty = F.array().cast("array<string>")
    return rows.withColumns({"imports": F.coalesce("imports", empty), "cross_references": F.coalesce("cross_references", empty), "is_heuristic": F.coalesce("is_heuristic", F.lit(False))})


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of JSON arrays in their order (``place``), read by splits; the job that uses them fails at a broken one, so see ``failing``."""
    with failing(path):
        spark.read.text(path)  # the path is there
        raw = read_array(spark, path, f"{REQUIRED}, {OPTIONAL}").select(F.struct("file", "element").alias("place"), "value.*")
        return check_chunks(raw)


@contextmanager
def failing(path: str) -> Iterator[None]:
    """Errors of jobs on the chunks of a file, as errors of that file."""
    try:
        yield
    except (PySparkException, Py4JJavaError) as e:
        raise IngestError(f"{path}: {str(e)[:500]}") from e


def dump_chunks(chunks: DataFrame, path: str) -> None:
    """Write chunks as JSON arrays that ``read_chunks`` reads, one in each file of a folder, in the order of their rows."""
    names = [c.split()[0] for c in f"{REQUIRED}, {OPTIONAL}".split(", ")]

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = "["
        for batch in batches:
            out = []
            for line in batch.column("line").to_pylist():
                out.append(before + line)
                before = ","
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["line"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if before == "[" else "]"])], ["line"])

    rows = chunks.select(F.to_json(F.struct(*[c for c in names if c in chunks.columns])).alias("line"))
    rows.mapInArrow(lines, "line string").write.text(path)


def corpus(rows: DataFrame, corpus_id: str) -> DataFrame:
    """The rows of one corpus of rows (corpus_id, ...); a KeyError if there is none of that id."""
    own = rows.filter(F.col("corpus_id") == corpus_id)
    if own.isEmpty():
        raise KeyError(corpus_id)
    return own


def read_suite(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(chunks, queries) of a suite: chunks with made-up places, queries with their gold."""
    one = spark.read.schema(SUITE).option("mode", "FAILFAST").json(path, multiLine=True).select(F.explode("corpora").alias("c"))
    chunks = one.select(F.col("c.id").alias("corpus_id"), F.posexplode("c.chunks").alias("place", "chunk")).select("corpus_id", "place", "chunk.*")
    start = F.col("place").cast("long") * STEP
    chunks = chunks.withColumns({"start_byte": start, "end_byte": start + F.octet_length("chunk_text")})
    queries = one.select(F.col("c.id").alias("corpus_id"), F.explode("c.queries").alias("q"))
    return chunks, queries.select("corpus_id", F.col("q.id").alias("query_id"), "q.query", F.coalesce("q.query_type", F.lit("keyword")).alias("query_type"), "q.gold_files", "q.gold_blocks")


def gold_of(context: Column) -> Column:
    """The gold blocks (file_path, symbol_name) in a JSON text: an array of objects with a file and lines, else none.

    Elements that aren't objects or whose file isn't a text go; a missing line counts as 0.
    """
    entries = F.coalesce(F.try_variant_get(F.try_parse_json(context), "$", "array<variant>"), F.array().cast("array<variant>"))
    kind = lambda e: F.schema_of_variant(F.try_variant_get(e, "$.file", "variant"))
    file = lambda e: F.try_variant_get(e, "$.file", "string")
    line = lambda e, at: F.coalesce(F.try_variant_get(e, f"$.{at}", "string"), F.lit("0"))
    good = F.filter(entries, lambda e: (kind(e) == "STRING") & (file(e) != ""))
    return F.array_sort(F.array_distinct(F.transform(good, lambda e: F.struct(file(e).alias("file_path"), F.concat(file(e), F.lit("::L"), line(e, "start_line"), F.lit("-L"), line(e, "end_line")).alias("symbol_name")))))


def benchmark_queries(records: DataFrame) -> DataFrame:
    """(corpus_id, query_id, query, query_type, gold_files, gold_blocks) of records (instance_id, repo, problem_statement, gold_context)."""
    rows = records.select(F.coalesce("repo", F.lit("")).alias("corpus_id"), F.coalesce("instance_id", F.lit("")).alias("query_id"), F.coalesce("problem_statement", F.lit("")).alias("query"), F.lit("keyword").alias("query_type"), gold_of(F.col("gold_context")).alias("gold_blocks"))
    return rows.withColumn("gold_files", F.array_distinct(F.transform("gold_blocks", lambda b: b["file_path"])))


def select_tasks(records: DataFrame, max_repos: int = 3, max_tasks: int = 15, languages: tuple[str, ...] = ("python", "typescript")) -> DataFrame:
    """The first tasks, by repository and id, of the first repositories that have tasks in the languages; both numbers are the selection."""
    own = records.filter(F.col("language").isin(*languages))
    repos = own.select("repo").distinct().orderBy("repo").limit(max_repos)
    return own.join(F.broadcast(repos), "repo", "left_semi").orderBy("repo", "instance_id").limit(max_tasks)


META = "arm string, task_id string, model string, temperature double, corpus_id string, query string"
TURN = "turn int, action string, action_kind string, observation string, prompt_tokens long, completion_tokens long, files_surfaced array<string>, blocks_surfaced array<array<string>>, wall_ms double"


def read_trajectories(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(meta, turns) of JSON lines, one trajectory a file (``trajectory``); a file without a line of meta makes the job fail."""
    rows = spark.read.schema(f"record string, {META}, {TURN}").json(path).withColumn("trajectory", F.input_file_name())
    names = lambda ddl: [c.split()[0] for c in ddl.split(", ")]
    meta = rows.filter("record = 'meta'").select("trajectory", *names(META))
    turns = rows.filter("record = 'turn'").join(meta.select("trajectory", F.lit(True).alias("known")).distinct(), "trajectory", "left")
    checked = F.when(F.col("known").isNull(), F.raise_error(F.concat(F.lit("no meta line: "), "trajectory"))).otherwise(F.col("trajectory"))
    return meta, turns.select(checked.alias("trajectory"), *names(TURN))


#: A line of a grep that declares a function or class: path, name; and such a line in shown text: name (fixed patterns).
GREP = r"(?m)^([^\s:]+):\d+:\s*(?:async\s+)?(?:def|class)\s+([A-Za-z_]\w*)"
SHOWN = r"(?m)^\s*(?:async\s+)?(?:def|class)\s+([A-Za-z_]\w*)"


def grep_blocks(observation: Column) -> Column:
    """Distinct (file_path, symbol_name) of lines ``path:line:`` that declare one, in order; a leading ``./`` goes."""
    path = F.transform(F.regexp_extract_all(observation, F.lit(GREP), F.lit(1)), lambda p: F.regexp_replace(F.replace(p, F.lit("\\"), F.lit("/")), r"^\./", ""))
    names = F.regexp_extract_all(observation, F.lit(GREP), F.lit(2))
    return F.array_distinct(F.zip_with(path, names, lambda p, n: F.struct(p.alias("file_path"), n.alias("symbol_name"))))


#: Letters of an anchor: more make it rarer in texts.
ANCHOR = 8


def contained(texts: DataFrame, patterns: DataFrame, key: str = "task") -> DataFrame:
    """(key, id, pattern): which patterns (key, pattern) stand in which texts (key, id, text) of the same key; each pair once.

    Not every pattern is held against every text: of its runs of ``ANCHOR`` letters a pattern takes the one that the fewest patterns of its key have, and is compared with
    the texts that hold that. Shorter patterns are their own anchors; the empty pattern stands in every text. Nulls stand nowhere. Anchors go to all tasks and
    are compared where a text lies, so that no text is shuffled, and of few a text keeps only those that there are; beyond ``MANY_TERMS`` they are joined without texts.
    """
    runs = lambda c, n: F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
    own = patterns.select(F.col(key).alias("key"), "pattern").filter("key is not null and pattern is not null").distinct()
    grams = own.filter(F.length("pattern") > ANCHOR).select("key", "pattern", F.explode(F.array_distinct(runs(F.col("pattern"), ANCHOR))).alias("anchor"))
    common = grams.groupBy("key", "anchor").agg(F.count("*").alias("n"))
    rarest = grams.join(common, ["key", "anchor"]).groupBy("key", "pattern").agg(F.min(F.struct("n", "anchor"))["anchor"].alias("anchor"))
    anchors = rarest.unionByName(own.filter(F.length("pattern") <= ANCHOR).select("key", "pattern", F.col("pattern").alias("anchor")))
    rows = texts.select(F.col(key).alias("key"), "id", "text").filter("key is not null and text is not null")
    sizes = sorted(r.n for r in anchors.select(F.length("anchor").alias("n")).distinct().collect())  # at most ANCHOR + 1
    known = [r.anchor for r in anchors.select("anchor").distinct().limit(FEW_TERMS + 1).collect()]
    every = F.concat(F.array().cast("array<string>"), *[runs(F.col("text"), n) if n else F.array(F.lit("")) for n in sizes])
    if len(known) <= FEW_TERMS:
        every = F.filter(every, lambda r: r.isin(known))
    held = F.explode(F.array_distinct(every)).alias("anchor")
    if anchors.limit(MANY_TERMS + 1).count() <= MANY_TERMS:
        found = rows.select("key", "id", "text", held).join(F.broadcast(anchors), ["key", "anchor"])
    else:
        found = rows.select("key", "id", held).join(anchors, ["key", "anchor"]).select("key", "id", "pattern").distinct().join(rows, ["key", "id"])
    found = found.filter(F.contains("text", "pattern"))
    return found.select(F.col("key").alias(key), "id", "pattern").distinct()


def surfaced(actions: DataFrame, repo_files: DataFrame) -> DataFrame:
    """(task, turn, files, blocks): what each action showed, first seen first.

    actions: (task, turn, command, observation), one row a turn; repo_files: (task, file_path). Blocks come from grep lines, then from
    the names shown by a command that names files of its task, by path.
    """
    command = F.replace(F.coalesce("command", F.lit("")), F.lit("\\"), F.lit("/"))
    named = contained(actions.select("task", F.col("turn").alias("id"), command.alias("text")), repo_files.select("task", F.col("file_path").alias("pattern")))
    named = named.groupBy("task", F.col("id").alias("turn")).agg(F.array_sort(F.collect_list("pattern")).alias("named"))
    rows = actions.join(named, ["task", "turn"], "left")
    seen = F.coalesce("observation", F.lit(""))
    files = F.coalesce("named", F.array().cast("array<string>"))
    rows = rows.select("task", "turn", files.alias("named"), grep_blocks(seen).alias("grep"), F.array_distinct(F.regexp_extract_all(seen, F.lit(SHOWN), F.lit(1))).alias("shown"))
    own = F.flatten(F.transform("named", lambda f: F.transform("shown", lambda n: F.struct(f.alias("file_path"), n.alias("symbol_name")))))
    listed = F.array_union(F.transform("grep", lambda b: b["file_path"]), F.col("named"))
    return rows.select("task", "turn", listed.alias("files"), F.array_union("grep", own).alias("blocks"))
