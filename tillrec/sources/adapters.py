"""Adapters from the driver's parquet tables to the canonical schema (survey 7.1).

``tx_retail``: lineitem ⋈ orders ⋈ part ⋈ supplier.  A customer is the card
holder, a part is the merchant, the supplier's nation is the merchant
category (its name is the category description), brand and type stand in for
city and state, the ship date is the transaction date, the extended price is
the amount (negated for returned lines, to exercise refunds), and the return
flag gives the fraud label (R → Yes, N → No, A → unlabelled).

``tx_events``: the events table (user → client, ``props.k`` → merchant,
``event_type`` → category, ``value`` → amount, ``ts`` → date).  It carries the
time of day that the retail tables lack.

All joins are left to the planner: small dimensions are broadcast by its size
estimate (a checked bound), large ones shuffle; only the fixed-size code
dimension (nation, 25 rows) carries an explicit broadcast hint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import format_money


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def retail_id():
    """Transaction id of a line: order key * 100 + line number.  Not unique in
    the driver data (duplicated lines exist), so nothing relies on uniqueness."""
    return F.col("l_orderkey") * 100 + F.col("l_linenumber")


def tx_retail_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw canonical transactions: amount is money text, date is a timestamp."""
    li = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    amount = F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice"))
    j = (
        li.join(orders, li.l_orderkey == orders.o_orderkey)
        .join(part, li.l_partkey == part.p_partkey)
        .join(supp, li.l_suppkey == supp.s_suppkey)
    )
    return j.select(
        retail_id().alias("id"),
        F.col("l_shipdate").alias("date"),
        F.col("o_custkey").alias("client_id"),
        format_money(amount).alias("amount"),
        F.col("l_partkey").alias("merchant_id"),
        F.col("p_brand").alias("merchant_city"),
        F.col("p_type").alias("merchant_state"),
        F.col("s_nationkey").cast("int").alias("mcc"),
    )


def retail_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id string, label) — one label per id; a duplicated id that is both
    returned and not gets 'Yes'."""
    li = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("R", "N"))
    lab = F.when(F.col("l_returnflag") == "R", F.lit("Yes")).otherwise(F.lit("No"))
    return li.groupBy(retail_id().cast("string").alias("id")).agg(F.max(lab).alias("label"))


def retail_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mcc string, mcc_description): the nation dimension as code map."""
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("string").alias("mcc"), F.col("n_name").alias("mcc_description"))


def retail_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users: customer rows; account balance stands in for yearly income.
    Age, debt and credit score do not exist in the driver data (null)."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("id"),
        F.lit(None).cast("int").alias("current_age"),
        format_money("c_acctbal").alias("yearly_income"),
        F.lit(None).cast("string").alias("total_debt"),
        F.lit(None).cast("int").alias("credit_score"),
    )


def retail_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards: one per customer; market segment is the card type and the
    account balance the credit limit."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("id"),
        F.col("c_custkey").alias("client_id"),
        F.col("c_mktsegment").alias("card_type"),
        format_money("c_acctbal").alias("credit_limit"),
    )


def tx_events_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("date"),
        F.col("user_id").alias("client_id"),
        format_money("value").alias("amount"),
        F.get_json_object("props", "$.k").cast("bigint").alias("merchant_id"),
        F.lit(None).cast("string").alias("merchant_city"),
        F.lit(None).cast("string").alias("merchant_state"),
        F.lit(None).cast("int").alias("mcc"),
        F.col("event_type").alias("mcc_description"),
    )
