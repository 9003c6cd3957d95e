"""Registered queries of the operators of this package, and their SQL where SQL can say the same."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rallyframe.llm import ann, chat, filters, jaccard, langid, licenses, lines, mixing, mtree, pieces, pii, ranking, suffix
from rallyframe.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
RECORDS_PER_BATCH = "512"


def prepare(spark: SparkSession) -> None:
    """Workers get the package; texts travel to Python in small batches, as single texts may be long."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", RECORDS_PER_BATCH)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, of: str, report: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: report(table(spark, sf_dir, of))
    if sql:
        ORACLES[name] = sql


register("op1_substring_dedup", "documents", lines.sentence_report, lines.oracle())
register("op2_chat_formatting", "conversations", chat.chat_report)
register("op3_source_mixing", "documents", mixing.mix_report)
register("op4_sentencepiece", "documents", pieces.encode_documents)
register("op5_jaccard_join", "documents", jaccard.jaccard_report)
register("op6_personal_data", "documents", pii.pii_report)
register("op8_language_id", "documents", langid.language_report)
register("op7_nearest_neighbours", "embeddings", ann.nearest)
register("op9_suffix_array_dedup", "documents", suffix.substring_report)
register("op10_exact_top_k", "embeddings", mtree.top_scores, mtree.oracle())
register("op13_license_scans", "documents", licenses.license_report, licenses.oracle())
QUERIES["op11_filter_audit"] = lambda spark, sf_dir: filters.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
ORACLES["op11_filter_audit"] = filters.oracle()
QUERIES["op12_ranked_search"] = lambda spark, sf_dir: ranking.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
ORACLES["op12_ranked_search"] = ranking.oracle()
