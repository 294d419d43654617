"""Registry of the article queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstream.plans import article_queries, cascade_queries, classifier_queries, edition_queries, gate_queries, history_queries, report_queries, store_queries, summary_queries

QUERIES = article_queries.QUERIES | edition_queries.QUERIES | gate_queries.QUERIES | report_queries.QUERIES | classifier_queries.QUERIES | cascade_queries.QUERIES | store_queries.QUERIES | summary_queries.QUERIES | history_queries.QUERIES
ORACLE_SQL = article_queries.SQL | edition_queries.SQL | gate_queries.SQL | report_queries.SQL | classifier_queries.SQL | store_queries.SQL | summary_queries.SQL | history_queries.SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked transactions of the article stream."""
    return article_queries.transaction_filter_topk(spark, sf_dir)
