"""Ranking quality over ranked rows (query_id, rank, item) and gold rows (query_id, item)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def at_k(ranked: DataFrame, gold: DataFrame, queries: DataFrame, ks: list[int]) -> DataFrame:
    """(query_id, k, recall, precision, f1, ndcg) of each query of queries (query_id).

    Without gold items recall and ndcg are 1; without ranked items precision is 0; repeated hits count each.
    """
    sizes = gold.distinct().groupBy("query_id").agg(F.count("*").alias("g"))
    hits = ranked.join(gold.distinct().withColumn("hit", F.lit(1)), ["query_id", "item"], "left")
    spread = hits.select("query_id", "rank", F.coalesce("hit", F.lit(0)).alias("hit"), F.explode(F.array(*map(F.lit, ks))).alias("k"))
    sums = spread.groupBy("query_id", "k").agg(
        F.sum(F.when(F.col("rank") <= F.col("k"), F.col("hit")).otherwise(0)).alias("h"),
        F.count("*").alias("n"),
        F.sum(F.when(F.col("rank") <= F.col("k"), F.col("hit") / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
    )
    out = queries.select("query_id", F.explode(F.array(*map(F.lit, ks))).alias("k")).join(sums, ["query_id", "k"], "left").join(sizes, "query_id", "left").fillna(0, ["h", "n", "g", "dcg"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least("k", F.col("g").cast("int")))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1.0)))
    recall = F.when(F.col("g") == 0, 1.0).otherwise(F.col("h") / F.col("g"))
    precision = F.when(F.col("n") == 0, 0.0).otherwise(F.col("h") / F.least("k", "n"))
    out = out.withColumn("recall", recall).withColumn("precision", precision)
    f1 = F.when(F.col("recall") + F.col("precision") == 0, 0.0).otherwise(2 * F.col("recall") * F.col("precision") / (F.col("recall") + F.col("precision")))
    return out.select("query_id", "k", "recall", "precision", f1.alias("f1"), F.when(F.col("g") == 0, 1.0).otherwise(F.col("dcg") / ideal).alias("ndcg"))


MEASURES = ("recall", "precision", "f1", "ndcg")
LEVELS = [f"{level}_{m}" for level in ("file", "block") for m in MEASURES]


def at_levels(ranked: DataFrame, gold_files: DataFrame, gold_blocks: DataFrame, queries: DataFrame, ks: list[int]) -> DataFrame:
    """(query_id, k, file_recall ... block_ndcg) of each query: the measures of ``at_k`` for the blocks as ranked, and for their files, each at its first block.

    ranked: (query_id, rank, file_path, item); gold: (query_id, item), of files by path.
    """
    first = ranked.groupBy("query_id", F.col("file_path").alias("item")).agg(F.min("rank").alias("first"))
    files = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("first"))).drop("first")
    named = lambda rows, level: rows.withColumnsRenamed({m: f"{level}_{m}" for m in MEASURES})
    blocks = at_k(ranked.select("query_id", "rank", "item"), gold_blocks, queries, ks)
    return named(at_k(files, gold_files, queries, ks), "file").join(named(blocks, "block"), ["query_id", "k"])


def macro_levels(rows: DataFrame, types: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys..., subset, k, n_queries, means of all measures): over all queries and over those of type ``keyword``; types: (query_id, query_type)."""
    subset = F.explode(F.when(F.col("query_type") == "keyword", F.array(F.lit("all"), F.lit("keyword"))).otherwise(F.array(F.lit("all")))).alias("subset")
    spread = rows.join(types.select("query_id", "query_type"), "query_id", "left").select(*keys, "k", *LEVELS, subset)
    return spread.groupBy(*keys, "subset", "k").agg(F.count("*").alias("n_queries"), *[F.avg(c).alias(c) for c in LEVELS])


def macro(rows: DataFrame) -> DataFrame:
    """Means of the measures for each k."""
    return rows.groupBy("k").agg(*[F.avg(c).alias(c) for c in ("recall", "precision", "f1", "ndcg")])


def coverage(turns: DataFrame, gold: DataFrame, threshold: float) -> DataFrame:
    """(task, turn, tokens): the first turn whose surfaced items, with those before, hold the share of gold; null if none.

    turns: (task, turn, tokens, items array); gold: (task, item).
    """
    first = turns.select("task", "turn", F.explode("items").alias("item")).join(gold.distinct(), ["task", "item"]).groupBy("task", "item").agg(F.min("turn").alias("turn"))
    new = first.groupBy("task", "turn").agg(F.count("*").alias("new"))
    run = Window.partitionBy("task").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    sizes = gold.distinct().groupBy("task").agg(F.count("*").alias("g"))
    rows = turns.select("task", "turn", "tokens").join(new, ["task", "turn"], "left").join(sizes, "task", "left")
    rows = rows.withColumn("seen", F.sum(F.coalesce("new", F.lit(0))).over(run)).withColumn("spent", F.sum("tokens").over(run))
    reached = F.coalesce("g", F.lit(0)) == 0
    reached = reached | (F.col("seen") >= F.lit(threshold) * F.col("g"))
    best = F.min(F.when(reached, F.struct("turn", "spent"))).alias("best")
    return rows.groupBy("task").agg(best).select("task", F.col("best.turn").alias("turn"), F.col("best.spent").alias("tokens"))


def weighted(rows: DataFrame, measures: list[str], keys: list[str]) -> DataFrame:
    """Means of the measures for each arm and k, weighted by ``n_queries``; zeros where no query counts."""
    n = F.sum("n_queries")
    return rows.groupBy(*keys).agg(n.alias("n_queries"), *[F.when(n > 0, F.sum(F.col(m) * F.col("n_queries")) / n).otherwise(0.0).alias(m) for m in measures])


def rank_configs(rows: DataFrame, measure: str, order: str = "ord") -> DataFrame:
    """Configurations from best to worst by a measure; ties keep the order of the grid. The grid is small."""
    return rows.orderBy(F.desc(measure), order)


def surfaced_lists(turns: DataFrame, items: str = "items") -> DataFrame:
    """(query_id, rank, item): what the turns (task, turn, items array) of each task surfaced, each item once, first seen first."""
    seen = turns.select(F.col("task").alias("query_id"), "turn", F.posexplode(items).alias("pos", "item")).groupBy("query_id", "item").agg(F.min(F.struct("turn", "pos")).alias("at"))
    return seen.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("at"))).select("query_id", "rank", "item")


def trajectories(turns: DataFrame, gold: DataFrame, ks: list[int], threshold: float) -> DataFrame:
    """(query_id, k, recall, precision, f1, ndcg, turn, tokens) of tasks: quality of all they surfaced, and when they covered the gold.

    turns: (task, turn, tokens, items array); gold: (task, item).
    """
    tasks = turns.select(F.col("task").alias("query_id")).distinct()
    scores = at_k(surfaced_lists(turns), gold.withColumnRenamed("task", "query_id"), tasks, ks)
    return scores.join(coverage(turns, gold, threshold).withColumnRenamed("task", "query_id"), "query_id")


def best_config(rows: DataFrame, measure: str, default: str = "default") -> DataFrame:
    """(config, value, agrees): the best of (config, ord, measure) and whether it is the default one."""
    best = rank_configs(rows, measure).limit(1)
    return best.select("config", F.col(measure).alias("value"), (F.col("config") == default).alias("agrees"))
