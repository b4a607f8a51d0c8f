"""Interaction tables, ratings, indexes and splits (survey D1-D7, F1-F5).

Everything stays a long sparse ``(user, item, value)`` table; no dense or
wide matrix is built except the bounded pivot sink D6.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import hash_unit, money_sum
from ..session import reliable
from .common import exact_quantiles, ordered_rank


def _keyed(tx: DataFrame, *keys: str) -> DataFrame:
    # pandas groupby drops rows whose key is null
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return tx.where(cond)


def interactions(tx: DataFrame, user: str = "client_id", item: str = "merchant_id") -> DataFrame:
    """(user, item, transaction_count = non-null amounts, total_amount)."""
    return _keyed(tx, user, item).groupBy(user, item).agg(
        F.count("amount").alias("transaction_count"), money_sum("amount").alias("total_amount")
    )


def category_interactions(tx: DataFrame, user: str = "client_id") -> DataFrame:
    """D2."""
    return interactions(tx, user, "mcc")


def pair_counts(tx: DataFrame, user: str = "client_id", item: str = "merchant_id", rows: bool = True) -> DataFrame:
    """(user, item, count) — rows (``size``) or non-null amounts."""
    agg = F.count(F.lit(1)) if rows else F.count("amount")
    return _keyed(tx, user, item).groupBy(user, item).agg(agg.alias("count"))


def pair_stats(tx: DataFrame, user: str = "client_id", item: str = "merchant_id", absolute: bool = True) -> DataFrame:
    """Frequency, mean and total amount per pair (on |amount| by default)."""
    amt = F.abs("amount") if absolute else F.col("amount")
    t = _keyed(tx, user, item).withColumn("_a", amt)
    return t.groupBy(user, item).agg(
        F.count("_a").alias("frequency"),
        (money_sum("_a") / F.count("_a")).alias("avg_amount"),
        money_sum("_a").alias("total_amount"),
    )


def pivot_counts(
    ix: DataFrame, row: str, col: str, values: list, value: str = "transaction_count", max_cols: int = 10_000,
    prefix: str | None = None,
) -> DataFrame:
    """Wide 0-filled count matrix for an explicit, bounded column list.
    Only a sink: analytics stay on the long table."""
    if len(values) > max_cols:
        raise ValueError(f"pivot over {len(values)} columns exceeds max_cols={max_cols}")
    p = ix.groupBy(row).pivot(col, values).agg(F.sum(value)).na.fill(0)
    if prefix is not None:
        for v in values:
            p = p.withColumnRenamed(str(v), f"{prefix}{v}")
    return p


def matrix_stats(ix: DataFrame, user: str = "client_id", item: str = "merchant_id") -> DataFrame:
    """(n_users, n_items, nnz, sparsity) without building the matrix."""
    s = ix.agg(
        F.countDistinct(user).alias("n_users"),
        F.countDistinct(item).alias("n_items"),
        F.count(F.lit(1)).alias("nnz"),
    )
    return s.withColumn(
        "sparsity", F.lit(1.0) - F.col("nnz") / (F.col("n_users").cast("double") * F.col("n_items"))
    )


def ratings(tx: DataFrame, user: str = "client_id", item: str = "merchant_id") -> DataFrame:
    """implicit rating on |amount|: raw = frequency·log1p(avg_amount),
    rating = 1 + 4·raw/max(raw).  The global max is one scalar job; when it
    is 0 every rating is 1.0 (the reference would produce NaN).  The pairs are
    written once; the max and the result read them from there."""
    st = pair_stats(tx, user, item, absolute=True)
    st = reliable(st.withColumn("_raw", F.col("frequency") * F.log1p("avg_amount")))
    mx = st.agg(F.max("_raw")).first()[0]
    if mx is None or mx == 0 or (isinstance(mx, float) and math.isnan(mx)):
        rating = F.lit(1.0)
    else:
        rating = F.lit(1.0) + F.lit(4.0) * (F.col("_raw") / F.lit(float(mx)))
    return st.withColumn("rating", rating).drop("_raw")


def index_ids(df: DataFrame, col: str, idx_col: str | None = None) -> DataFrame:
    """dense 0-based index of the distinct non-null values, ascending."""
    idx_col = idx_col or f"{col}_idx"
    d = df.select(col).where(F.col(col).isNotNull()).distinct().withColumn("_lvl", F.lit(0))
    r = ordered_rank(d, "_lvl", col, rank_col="_r")
    return r.select(col, (F.col("_r") - 1).alias(idx_col))


def split_interactions(
    r: DataFrame, test_ratio: float = 0.2, salt: str = "split", user: str = "client_id", item: str = "merchant_id"
) -> DataFrame:
    """stateless hash split; adds ``is_test``.  A pair's side depends only
    on (salt, user, item), never on partitioning or row order."""
    thr = int(round(test_ratio * 10000))
    return r.withColumn("is_test", hash_unit(user, item, salt=salt) < F.lit(thr))


def split_by_time(tx: DataFrame, test_ratio: float = 0.2, time: str = "date") -> DataFrame:
    """F5 by time: adds ``is_test``, true for rows later than one moment for
    all users, so that no training row is later than a test row.  The moment
    is the time at rank floor((n − 1)·(1 − ratio)) of the n rows that have
    one, found by selection; rows at that very moment train, so the test
    side is at most ``test_ratio``.  Rows without a time train.  The rows are
    written once; all scans and the result read them from there."""
    tx = reliable(tx)
    seconds = F.col(time).cast("timestamp").cast("double")
    n = tx.where(F.col(time).isNotNull()).count()
    if not n:
        return tx.withColumn("is_test", F.lit(False))
    rank = int((n - 1) * (1 - test_ratio) + 1e-9)
    moment = exact_quantiles(tx.select(seconds.alias("t")), [rank / (n - 1) if n > 1 else 0.0]).first()["value"]
    # the quantile may be a rounding away from the rank's value, which is a whole microsecond
    moment = round(moment * 1e6) / 1e6
    return tx.withColumn("is_test", F.coalesce(seconds > F.lit(moment), F.lit(False)))


def leave_last(tx: DataFrame, user: str = "client_id", time: str = "date", tie: str = "id", min_rows: int = 2) -> DataFrame:
    """F5, per user: adds ``is_test``, true for the last row of each user with
    at least ``min_rows`` rows, by (time, tie); equal ones are all last.  A
    user's last row is a partial and final aggregate, so a user with very
    many rows is never one window."""
    key = F.struct(F.col(time).alias("t"), F.col(tie).alias("i"))
    last = tx.where(F.col(user).isNotNull() & F.col(time).isNotNull()).groupBy(F.col(user).alias("_u")).agg(
        F.max(key).alias("_last"), F.count(F.lit(1)).alias("_n"))
    j = tx.join(last, tx[user] == last["_u"], "left")
    test = (F.col("_n") >= min_rows) & (key == F.col("_last"))
    return j.select(*[tx[c] for c in tx.columns], F.coalesce(test, F.lit(False)).alias("is_test"))
