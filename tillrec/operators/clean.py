"""Cleaning and lookups (survey C1-C9, J1, J2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import amount_category, date_parts, fraud_flag, parse_money, parse_timestamp
from ..sources.schemas import CLEAN_COLUMNS
from .common import checked_broadcast


def with_fraud_flag(tx: DataFrame, labels: DataFrame) -> DataFrame:
    """Left lookup of the label by the id's text form; unlabelled → 0.
    ``labels`` must hold one row per id (a dictionary)."""
    lab = labels.select(F.col("id").cast("string").alias("_lid"), F.col("label").alias("_label"))
    j = tx.join(lab, tx["id"].cast("string") == lab["_lid"], "left")
    return j.withColumn("is_fraud", fraud_flag("_label")).drop("_lid", "_label")


def with_category(tx: DataFrame, codes: DataFrame, default: str | None = None) -> DataFrame:
    """Left lookup of the code description; a miss is null or ``default``.
    The code dictionary is broadcast after a size check."""
    c = codes.select(F.col("mcc").cast("string").alias("_code"), F.col("mcc_description").alias("_desc"))
    j = tx.join(checked_broadcast(c), tx["mcc"].cast("string") == F.col("_code"), "left")
    desc = F.col("_desc") if default is None else F.coalesce(F.col("_desc"), F.lit(default))
    return j.withColumn("mcc_description", desc).drop("_code", "_desc")


def clean_transactions(
    raw: DataFrame,
    labels: DataFrame | None = None,
    codes: DataFrame | None = None,
    date_format: str | None = None,
    lenient: bool = False,
) -> DataFrame:
    """Day-1 cleaning in one projection chain plus two lookups:
    parse date and money text, fraud flag, category description, date parts
    and the amount bucket."""
    tx = raw.withColumn("date", parse_timestamp("date", date_format, lenient)).withColumn(
        "amount", parse_money("amount", lenient)
    )
    if labels is not None:
        tx = with_fraud_flag(tx, labels)
    else:
        tx = tx.withColumn("is_fraud", F.lit(0))
    if codes is not None:
        tx = with_category(tx.drop("mcc_description") if "mcc_description" in tx.columns else tx, codes)
    elif "mcc_description" not in tx.columns:
        tx = tx.withColumn("mcc_description", F.lit(None).cast("string"))
    for name, expr in date_parts("date").items():
        tx = tx.withColumn(name, expr)
    tx = tx.withColumn("amount_category", amount_category("amount"))
    return tx.select(*CLEAN_COLUMNS)


def merchant_info(tx: DataFrame) -> DataFrame:
    """Place and category of each merchant, taken from its first
    transaction by (date, id) — ties broken by the remaining fields.  One
    partial+final aggregate; a hot merchant costs one row per map task."""
    first = F.min(
        F.struct(
            F.col("date"), F.col("id"), F.col("merchant_city"), F.col("merchant_state"),
            F.col("mcc"), F.col("mcc_description"),
        )
    ).alias("_f")
    return tx.groupBy("merchant_id").agg(first).select(
        "merchant_id",
        F.col("_f.merchant_city").alias("merchant_city"),
        F.col("_f.merchant_state").alias("merchant_state"),
        F.col("_f.mcc").alias("mcc"),
        F.col("_f.mcc_description").alias("mcc_description"),
    )
