"""The registered queries of this subpackage: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fill_middle, language_id, line_quality, media, mixing, ngram_join, personal_data, repeats, runs, secrets, tool_calls, url_reputation


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.train_on_rest(docs)
    out = language_id.identify(docs, model)
    return out.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("domain", mixing.domain_of(F.col("source")))
    return mixing.mix(docs)


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the clips as text: start and end in seconds and the grey level of each."""
    found = media.read(media.store(_table(spark, sf_dir, "documents")))
    clip = lambda c: F.format_string("%.1f-%.1f:%.3f", c["start"], c["end"], c["level"])
    return found.withColumn("clips", F.array_join(F.transform("clips", clip), ";")).drop("problem")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the same id are the outcomes of pages; low quality or a toxic one is bad."""
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.greatest(1 - F.col("quality"), "toxic").alias("bad"))
    return url_reputation.judge(_table(spark, sf_dir, "pages"), labels).drop("bad_sure")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return personal_data.digest(personal_data.scan(docs, personal_data.fit(docs)))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.find(_table(spark, sf_dir, "documents"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.link(*tool_calls.calls_of(_table(spark, sf_dir, "conversations")), tool_calls.SCHEMAS)


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(_table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.find(runs.planted(_table(spark, sf_dir, "documents"))))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    field = line_quality.train_on_rest(docs, _table(spark, sf_dir, "labels"))
    return line_quality.judge(docs, field).select("doc_id", line_quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_lines", "n_bad")


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_source_mixing,
        op3_ngram_jaccard_join,
        op4_media_columns,
        op5_url_filters,
        op6_personal_data,
        op7_benchmark_decontamination,
        op8_substring_dedup,
        op9_chat_formatting,
        op10_secret_scans,
        op11_periodic_runs,
        op12_quality_classifier,
        op13_fill_middle,
    )
}

ORACLES: dict[str, str] = {"op2_source_mixing": mixing.ORACLE, "op5_url_filters": url_reputation.ORACLE, "op10_secret_scans": secrets.ORACLE, "op11_periodic_runs": runs.ORACLE, "op13_fill_middle": fill_middle.ORACLE}
