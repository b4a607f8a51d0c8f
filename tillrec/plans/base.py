"""Base inputs every registered query starts from (Spark side)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.clean import clean_transactions
from ..operators.interactions import interactions, pair_counts
from ..sources import adapters as A


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned retail transactions (labels and category codes looked up)."""
    return clean_transactions(
        A.tx_retail_raw(spark, sf_dir), A.retail_labels(spark, sf_dir), A.retail_codes(spark, sf_dir)
    )


def tx_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned retail transactions for queries that read neither the fraud
    flag nor the category: skips both lookups (is_fraud = 0, no category)."""
    return clean_transactions(A.tx_retail_raw(spark, sf_dir))


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned event transactions (carry a time of day)."""
    return clean_transactions(A.tx_events_raw(spark, sf_dir))


def ix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1 interactions of the retail transactions."""
    return interactions(tx_plain(spark, sf_dir))


def cf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3 row counts per (user, item), the input of the neighbourhood and
    popularity models: a transaction without an amount counts too."""
    return visits(tx_plain(spark, sf_dir))


def visits(transactions: DataFrame) -> DataFrame:
    return pair_counts(transactions).withColumnRenamed("count", "transaction_count")
