"""Search results and outlines as text. A query's rows are bounded by its top k and token budget, so one row holds its output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RULE = "─" * 56


def qualified(parent: Column, name: Column) -> Column:
    return F.concat_ws(".", parent, name)


def json_value(value: Column) -> Column:
    """A single value in JSON, escaped."""
    whole = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def _joined(results: DataFrame, queries: DataFrame, block: Column, separator: str) -> DataFrame:
    """Blocks of each query in order of rank, with counts; queries (query_id, query, found) without results have none."""
    lists = results.select("query_id", "tokens", F.struct("rank", block.alias("block")).alias("b")).groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list("b")), lambda b: b["block"]).alias("blocks"), F.sum("tokens").alias("spent")
    )
    out = queries.join(lists, "query_id", "left").withColumn("shown", F.coalesce(F.size("blocks"), F.lit(0))).withColumn("spent", F.coalesce("spent", F.lit(0)))
    return out.withColumn("body", F.coalesce(F.array_join("blocks", separator), F.lit("")))


def as_text(results: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, output) of packed results (query_id, rank, symbol_name, symbol_type, parent_symbol, file_path, start_line, end_line, score, text, tokens)."""
    head = F.format_string("[%d] %s (%s) %s:%d-%d (score: %.2f)\n", "rank", qualified(F.col("parent_symbol"), F.col("symbol_name")), "symbol_type", "file_path", "start_line", "end_line", "score")
    rows = _joined(results, queries, F.concat(head, F.col("text"), F.lit("\n\n")), "")
    counts = F.format_string("Found %d results (showing top %d, %d tokens)\n", "found", "shown", "spent")
    return rows.select("query_id", F.concat(F.lit(f'{RULE}\nQuery: "'), "query", F.lit('"\n'), counts, F.lit(f"{RULE}\n\n"), "body", F.lit(f"{RULE}\n")).alias("output"))


def as_json(results: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, output): the query, its counts and its chunks, indented by two spaces, without an end of line."""
    fields = {"symbol_name": "symbol_name", "symbol_type": "symbol_type", "file_path": "file_path", "start_byte": "start_byte", "end_byte": "end_byte", "language": "language", "bm25_score": "score", "chunk_text": "text"}
    lines = [F.concat(F.lit(f'      "{k}": '), json_value(F.col(c))) for k, c in fields.items()]
    rows = _joined(results, queries, F.concat(F.lit("    {\n"), F.concat_ws(",\n", *lines), F.lit("\n    }")), ",\n")
    chunks = F.when(F.col("shown") > 0, F.concat(F.lit("[\n"), "body", F.lit("\n  ]"))).otherwise("[]")
    head = [F.concat(F.lit(f'  "{k}": '), json_value(F.col(c))) for k, c in {"query": "query", "total_results": "found", "total_tokens": "spent"}.items()]
    return rows.select("query_id", F.concat(F.lit("{\n"), F.concat_ws(",\n", *head, F.concat(F.lit('  "chunks": '), chunks)), F.lit("\n}")).alias("output"))


def as_locators(results: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, output): a line ``file:start-end`` for each result; empty without results."""
    block = F.format_string("%s:%d-%d\n", "file_path", "start_line", "end_line")
    return _joined(results, queries, block, "").select("query_id", F.col("body").alias("output"))


def under(file_path: Column, path: str) -> Column:
    """Whether a file is ``path``, or lies below it; below it A to Z count alike in either case."""
    lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (file_path == path) | lower(file_path).startswith(lower(F.lit(path.rstrip("/") + "/")))


def outline(symbols: DataFrame, path: str, max_tokens: int = 2000) -> DataFrame:
    """(line_no, line) of an outline of symbols below ``path``: two head lines, then symbols while a quarter of the bytes fits the budget.

    A line has four bytes at least, so no more than ``max_tokens`` of the first symbols can fit: they are taken
    by a distributed top-k before the running sum. The head counts all symbols.
    """
    own = symbols.filter(under(F.col("file_path"), path))
    order = ["file_path", "start_line", "end_line", "symbol_name"]
    top = own.orderBy(*order).limit(max_tokens + 1).withColumn("n", F.row_number().over(Window.orderBy(*order)))
    line = F.format_string("[%d] %s (%s) %s:%d-%d", "n", qualified(F.col("parent_symbol"), F.col("symbol_name")), "symbol_type", "file_path", "start_line", "end_line")
    count = own.agg(F.count("*").alias("total"))
    heads = count.select(F.explode(F.array(F.struct(F.lit(-1).alias("n"), F.lit(f'Path: "{path}"').alias("line")), F.struct(F.lit(0).alias("n"), F.format_string("Found %d symbols", "total").alias("line")))).alias("h")).select("h.*")
    run = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = heads.unionByName(top.select("n", line.alias("line"))).withColumn("bytes", F.sum(F.octet_length("line") + 1).over(run))
    return rows.filter((F.col("n") <= 0) | (F.floor(F.col("bytes") / 4) <= max_tokens)).select((F.col("n") + 2).cast("int").alias("line_no"), "line")


def _table(rows: DataFrame, columns: list[str], order: list, head: str) -> DataFrame:
    """(output) with one Markdown table of a bounded report: one line for each configuration or arm."""
    cells = [F.format_string("%.4f", c) if t == "double" else F.col(c).cast("string") for c, t in rows.select(*columns).dtypes]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c, F.lit("")) for c in cells]), F.lit(" |"))
    title = f"## {head}\n\n| {' | '.join(columns)} |\n|{'---|' * len(columns)}\n"
    lists = rows.agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))).alias("l"))
    return lists.select(F.when(F.size("l") > 0, F.concat(F.lit(title), F.array_join(F.transform("l", lambda r: r["line"]), "\n"))).otherwise(F.lit(f"## {head}\n\n_none_")).alias("output"))


def ablation_report(configs: DataFrame, arms: DataFrame, k: int = 10) -> DataFrame:
    """(output): a Markdown report of weight vectors (config, ord, weights, k, f1, ndcg) and arms (arm, ord, n_queries, k, f1, ndcg).

    The best vector by NDCG is named, and whether it is the default one; no arm is called better. Both tables have a row for
    each configuration, so they are small.
    """
    own = configs.filter(F.col("k") == k)
    best = own.agg(F.max_by("config", F.struct("ndcg", -F.col("ord"))).alias("best"), F.max("ndcg").alias("value"))
    note = F.format_string(f"Best by NDCG@{k}: **%s** (%.4f); the default is the best: **%s**", "best", "value", F.when(F.col("best") == "default", "yes").otherwise("no"))
    first = _table(own, ["config", "weights", "f1", "ndcg"], ["ord"], f"Weight vectors at {k}").withColumnRenamed("output", "a")
    second = _table(arms.filter(F.col("k") == k), ["arm", "n_queries", "f1", "ndcg"], ["ord"], f"Arms at {k}").withColumnRenamed("output", "b")
    rows = first.join(F.broadcast(second)).join(F.broadcast(best))  # one row each
    return rows.select(F.concat_ws("\n\n", "a", "b", F.coalesce(note, F.lit("No weight vectors."))).alias("output"))
