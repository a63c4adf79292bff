"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and works on all that the one before kept.

Rows of one doc_id are one document: they stay or go together, and come out as often as they went in. Rows without a doc_id are
never taken for copies or for leaks. Null and empty texts have no language and go in the first stage; an empty table stays empty. Further columns
stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, language_id, mixing, ngram_join, secrets
from quarry.llm._common import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters and those of which no language holds half."""
    found = language_id.identify(docs, language_id.train_on_rest(docs), whole=True)
    return found.filter("lang_pred <> 'und' and score >= 0.5").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of linked documents."""
    copies = ngram_join.near_duplicates(docs, counted=False).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage like an item of the benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by a mark; every document stays."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents taken for half of the tokens, with their domain, tokens and how often each is taken; these replace columns of the same names."""
    taken = mixing.mix(docs.withColumn("domain", mixing.domain_of(F.col("source"))), whole=True)
    return taken.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in NEW], *NEW)


#: Columns that the last stage adds.
NEW = ["domain", "tokens", "epochs"]

STAGES: list[tuple[str, Stage]] = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
]

#: Language models, similarity joins and loopy scores have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
