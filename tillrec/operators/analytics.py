"""Descriptive analytics behind the reference's charts (survey D8-D29, W1-W3).

Every table is a grouped aggregate (partial aggregation before the shuffle);
global top-N lists are ``orderBy.limit`` (TakeOrderedAndProject).  Chart
rendering itself is not rebuilt: these are the tables a chart would draw.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import (
    DAY_NAMES, clip, ellipsize, format_day, money_sum, month_name, safe_ratio, weekday_name,
)
from .common import ordered_rank


def _count(name: str = "n"):
    return F.count(F.lit(1)).alias(name)


def per_hour(tx: DataFrame) -> DataFrame:
    """(hour, n)."""
    return tx.where(F.col("hour").isNotNull()).groupBy("hour").agg(_count())


def per_weekday(spark: SparkSession, tx: DataFrame) -> DataFrame:
    """(day_of_week, day_name, n) for all seven days (absent days → 0)."""
    counts = tx.where(F.col("day_of_week").isNotNull()).groupBy("day_of_week").agg(_count())
    days = spark.range(len(DAY_NAMES)).select(F.col("id").cast("int").alias("day_of_week"))
    return (
        days.join(counts, "day_of_week", "left")
        .select("day_of_week", weekday_name("day_of_week").alias("day_name"), F.coalesce("n", F.lit(0)).alias("n"))
    )


def top_values(tx: DataFrame, col: str, n: int = 10, label_chars: int | None = None, out: str | None = None) -> DataFrame:
    """The n most frequent non-null values (count desc, value asc),
    optionally with an ellipsized label (C10)."""
    out = out or col
    g = tx.where(F.col(col).isNotNull()).groupBy(F.col(col).alias(out)).agg(_count())
    top = g.orderBy(F.col("n").desc(), F.col(out).asc()).limit(n)
    if label_chars:
        top = top.withColumn("label", ellipsize(out, label_chars))
    return top


def fraud_share(tx: DataFrame) -> DataFrame:
    """(is_fraud, n, pct) — pct of all rows."""
    g = tx.groupBy("is_fraud").agg(_count())
    return g.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 6))


def amount_buckets(tx: DataFrame) -> DataFrame:
    """(amount_category, n), null bucket dropped."""
    return tx.where(F.col("amount_category").isNotNull()).groupBy("amount_category").agg(_count())


def monthly(tx: DataFrame) -> DataFrame:
    """Months of all years merged: (month, month_name, n, total_amount)."""
    g = tx.where(F.col("month").isNotNull()).groupBy("month").agg(
        F.count("amount").alias("n"), money_sum("amount").alias("total_amount")
    )
    return g.select("month", month_name("month").alias("month_name"), "n", "total_amount")


def category_stats(tx: DataFrame, n: int = 15) -> DataFrame:
    """Top categories by frequency with the mean amount."""
    g = tx.where(F.col("mcc_description").isNotNull()).groupBy(F.col("mcc_description").alias("category")).agg(
        F.count("amount").alias("frequency"),
        F.round(money_sum("amount") / F.count("amount"), 6).alias("avg_amount"),
    )
    return g.orderBy(F.col("frequency").desc(), F.col("category").asc()).limit(n)


def histogram(
    spark: SparkSession, df: DataFrame, col: str, bins: int, lo: float | None = None, hi: float | None = None,
    clip_range: tuple[float, float] | None = None,
) -> DataFrame:
    """Equal-width histogram, last bin closed: (bin, bin_lo, bin_hi, n)
    with empty bins present.  Range from the data (one scalar job) unless
    given; a degenerate range is widened by ±0.5 as NumPy does."""
    x = F.col(col).cast("double")
    if clip_range is not None:
        x = clip(x, *clip_range)
    v = df.select(x.alias("_x")).where(F.col("_x").isNotNull())
    if lo is None or hi is None:
        mn, mx = v.agg(F.min("_x"), F.max("_x")).first()
        if mn is None:
            mn, mx = 0.0, 1.0
        lo = mn if lo is None else lo
        hi = mx if hi is None else hi
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    lo_c, hi_c = F.lit(float(lo)), F.lit(float(hi))
    b = F.least(F.floor((F.col("_x") - lo_c) / (hi_c - lo_c) * F.lit(bins)), F.lit(bins - 1)).cast("int")
    counts = v.groupBy(b.alias("bin")).agg(_count())
    all_bins = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    width = (hi_c - lo_c) / F.lit(bins)
    return all_bins.join(counts, "bin", "left").select(
        "bin",
        F.round(lo_c + F.col("bin") * width, 6).alias("bin_lo"),
        F.round(lo_c + (F.col("bin") + 1) * width, 6).alias("bin_hi"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def share_table(df: DataFrame, col: str) -> DataFrame:
    """(value, n, share) with share of all non-null rows."""
    g = df.where(F.col(col).isNotNull()).groupBy(col).agg(_count())
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def dataset_summary(tx: DataFrame) -> DataFrame:
    """One row of headline numbers."""
    return tx.agg(
        F.count(F.lit(1)).alias("n_transactions"),
        F.countDistinct("client_id").alias("n_users"),
        F.countDistinct("merchant_id").alias("n_merchants"),
        F.countDistinct("mcc").alias("n_categories"),
        F.sum("is_fraud").cast("bigint").alias("n_fraud"),
        F.round(F.avg("is_fraud") * 100.0, 6).alias("fraud_pct"),
        F.round(money_sum("amount") / F.count("amount"), 6).alias("avg_amount"),
        money_sum("amount").alias("total_amount"),
        format_day(F.min("date")).alias("first_date"),
        format_day(F.max("date")).alias("last_date"),
    )


def demographics(users: DataFrame, cards: DataFrame) -> DataFrame:
    """Mean age, income and credit score of users; number of cards and
    mean credit limit — as long (metric, value) rows, one aggregate per table.
    Income and limit arrive as money text."""
    from ..functions.scalar import parse_money

    inc, lim = parse_money("yearly_income"), parse_money("credit_limit")
    u = users.agg(
        F.round(F.avg("current_age"), 6).alias("avg_age"),
        F.round(money_sum(inc) / F.count(inc), 6).alias("avg_income"),
        F.round(F.avg("credit_score"), 6).alias("avg_credit_score"),
    )
    c = cards.agg(
        F.count(F.lit(1)).cast("double").alias("n_cards"),
        F.round(money_sum(lim) / F.count(lim), 6).alias("avg_credit_limit"),
    )

    def longer(df: DataFrame) -> DataFrame:
        items = [F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in df.columns]
        return df.select(F.explode(F.array(*items)).alias("_m")).select("_m.*")

    return longer(u).unionByName(longer(c))


def per_user_counts(tx: DataFrame, user: str = "client_id") -> DataFrame:
    """(user, n)."""
    return tx.where(F.col(user).isNotNull()).groupBy(user).agg(_count())


def merchant_popularity(tx: DataFrame, item: str = "merchant_id") -> DataFrame:
    """(item, n)."""
    return tx.where(F.col(item).isNotNull()).groupBy(item).agg(_count())


def cold_start(tx: DataFrame, threshold: int = 5) -> DataFrame:
    """Users below ``threshold`` transactions, single-transaction users,
    mean transactions per user."""
    u = per_user_counts(tx)
    return u.agg(
        F.count(F.lit(1)).alias("n_users"),
        F.sum((F.col("n") < threshold).cast("bigint")).alias("users_lt_threshold"),
        F.round(F.avg((F.col("n") < threshold).cast("double")) * 100.0, 6).alias("pct_lt_threshold"),
        F.sum((F.col("n") == 1).cast("bigint")).alias("single_tx_users"),
        F.round(F.avg("n"), 6).alias("mean_tx_per_user"),
    )


def single_tx_merchants(tx: DataFrame) -> DataFrame:
    """D23."""
    m = merchant_popularity(tx)
    return m.agg(F.count(F.lit(1)).alias("n_merchants"), F.sum((F.col("n") == 1).cast("bigint")).alias("single_tx_merchants"))


def category_user_diversity(tx: DataFrame, n: int = 15, label_chars: int = 20) -> DataFrame:
    """Distinct users per category, top n, with ellipsized label."""
    g = tx.where(F.col("mcc_description").isNotNull()).groupBy(F.col("mcc_description").alias("category")).agg(
        F.countDistinct("client_id").alias("n_users")
    )
    top = g.orderBy(F.col("n_users").desc(), F.col("category").asc()).limit(n)
    return top.withColumn("label", ellipsize("category", label_chars))


def binned_pairs(df: DataFrame, x: str, y: str, x_width: float, y_width: float) -> DataFrame:
    """D25 at scale: 2-D binned counts instead of a raw scatter."""
    return (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(
            F.floor(F.col(x) / x_width).cast("bigint").alias("x_bin"),
            F.floor(F.col(y) / y_width).cast("bigint").alias("y_bin"),
        )
        .agg(_count())
    )


def pair_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, corr) of the rows that have both numbers."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.agg(F.count(F.lit(1)).alias("n"), F.round(F.corr(x, y), 6).alias("corr"))


def characteristics(tx: DataFrame) -> DataFrame:
    """Users, merchants, transactions per user."""
    return tx.agg(
        F.countDistinct("client_id").alias("total_users"),
        F.countDistinct("merchant_id").alias("total_merchants"),
        F.round(F.count(F.lit(1)) / F.countDistinct("client_id"), 6).alias("avg_tx_per_user"),
    )


def user_profile(tx: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Per user n, total, mean, distinct merchants (all users at once)."""
    t = tx if users is None else tx.join(users.select("client_id").distinct(), "client_id", "left_semi")
    return t.where(F.col("client_id").isNotNull()).groupBy("client_id").agg(
        F.count(F.lit(1)).alias("n_transactions"),
        money_sum("amount").alias("total_amount"),
        F.round(money_sum("amount") / F.count("amount"), 6).alias("avg_amount"),
        F.countDistinct("merchant_id").alias("n_merchants"),
    )


def user_top_categories(tx: DataFrame, k: int = 5) -> DataFrame:
    """Each user's k most frequent categories."""
    from .common import top_n_per_group

    g = tx.where(F.col("client_id").isNotNull() & F.col("mcc_description").isNotNull()).groupBy(
        "client_id", "mcc_description"
    ).agg(_count())
    return top_n_per_group(g, ["client_id"], [F.col("n").desc(), F.col("mcc_description").asc()], k)


def user_top_merchants(tx: DataFrame, k: int = 5) -> DataFrame:
    """Each user's k most frequent (merchant, city, category); rows with
    a null key part are dropped as pandas groupby does."""
    from .common import top_n_per_group

    keys = ["client_id", "merchant_id", "merchant_city", "mcc_description"]
    cond = None
    for c in keys:
        cond = F.col(c).isNotNull() if cond is None else cond & F.col(c).isNotNull()
    g = tx.where(cond).groupBy(*keys).agg(_count())
    order = [F.col("n").desc(), F.col("merchant_id").asc(), F.col("merchant_city").asc(), F.col("mcc_description").asc()]
    return top_n_per_group(g, ["client_id"], order, k)


def long_tail(tx: DataFrame, item: str = "merchant_id") -> DataFrame:
    """Merchants ranked by popularity (n desc, id asc) with the running
    share of transactions.

    Within one popularity level every merchant adds the same n, so
    cum(rank) = (sum over better levels) + n·(rank − merchants on better
    levels).  Only the level table (one row per distinct count; at most
    √(2·rows) rows, hence broadcast) needs a global window; the ranks come
    from the range-partitioned ``ordered_rank``."""
    pop = merchant_popularity(tx, item)
    ranked = ordered_rank(pop, "n", item)
    lv = pop.groupBy("n").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)
    lv = lv.select(
        "n",
        F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_g_gt"),
        F.coalesce(F.sum(F.col("_c") * F.col("n")).over(w), F.lit(0)).alias("_s_gt"),
        F.sum(F.col("_c") * F.col("n")).over(Window.partitionBy()).alias("_total"),
    )
    j = ranked.join(F.broadcast(lv), "n")
    cum = F.col("_s_gt") + F.col("n") * (F.col("rank") - F.col("_g_gt"))
    return j.select("rank", item, "n", F.round(cum / F.col("_total"), 6).alias("cum_share"))


def share_at_rank(tx: DataFrame, fraction: float = 0.2) -> DataFrame:
    """Cumulative share at 0-based position int(m·fraction), i.e. after
    int(m·fraction)+1 merchants (the reference's index rule)."""
    lt = long_tail(tx)
    m = lt.agg(F.count(F.lit(1)).alias("n_merchants"))
    pos = m.select("n_merchants", F.floor(F.col("n_merchants") * F.lit(fraction)).cast("bigint").alias("position"))
    return pos.join(lt, F.col("rank") == F.col("position") + 1).select(
        "n_merchants", "position", F.col("cum_share").alias("share_at_rank")
    )


def pareto_point(tx: DataFrame, share: float = 0.8) -> DataFrame:
    """First rank whose running share reaches ``share`` and the fraction
    of merchants that took."""
    lt = long_tail(tx)
    return lt.agg(
        F.min(F.when(F.col("cum_share") >= share, F.col("rank"))).alias("rank_at_share"),
        F.count(F.lit(1)).alias("n_merchants"),
    ).withColumn("merchant_fraction", F.round(safe_ratio("rank_at_share", "n_merchants"), 6))
