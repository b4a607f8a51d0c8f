"""Evaluation layer (survey G1-G12), set-at-a-time.

One deterministic holdout is drawn once and reused for every K and every
model (fixing X3-X6 of the survey): the holdout items are hidden from the
training interactions *before* any model is built, candidates are the items
the user did not use in training, and the relevance set is the user's
holdout.  Precision divides by the number of items actually recommended
(≤ K), recall by the holdout size; the mean is over eligible users and F1 is
taken of the means.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import f1, fixed4_or_na, hash_key, safe_ratio
from .similarity import pair_similarity

KS = (5, 10, 20)
LOWER_IS_BETTER = ("rmse", "mae")


def holdout_per_user(
    ix: DataFrame, divisor: int = 3, min_items: int = 3, salt: str = "holdout",
    user: str = "client_id", item: str = "merchant_id",
) -> DataFrame:
    """G1 + G2: adds ``n_items`` and ``is_holdout``.  Users with at least
    ``min_items`` items hide max(1, n // divisor) of them: the items with the
    smallest md5 key of (salt, user, item), ties by item id.  The window is
    per user over the *aggregated* interactions, so a group never exceeds
    the catalogue size however many raw transactions a user has."""
    w = Window.partitionBy(user)
    wo = Window.partitionBy(user).orderBy(hash_key(user, item, salt=salt), F.col(item))
    t = ix.withColumn("n_items", F.count(F.lit(1)).over(w)).withColumn("_hr", F.row_number().over(wo))
    k = F.greatest(F.lit(1), F.floor(F.col("n_items") / F.lit(divisor)))
    return t.withColumn("is_holdout", (F.col("n_items") >= min_items) & (F.col("_hr") <= k)).drop("_hr")


def sample_users(ix: DataFrame, n: int | None = None, salt: str = "users", user: str = "client_id") -> DataFrame:
    """Evaluation users — all by default; ``n`` picks a repeatable
    hash-ordered subset (opt-in)."""
    u = ix.select(user).distinct()
    if n is None:
        return u
    return u.orderBy(hash_key(user, salt=salt), F.col(user)).limit(n)


def ranking_metrics(
    recs: DataFrame, relevant: DataFrame, users: DataFrame, ks=KS,
    user: str = "client_id", item: str = "merchant_id", model_col: str = "model", models: list[str] | None = None,
) -> DataFrame:
    """G4 + G5: (model, k, n_users, precision, recall, f1).

    ``recs`` (model, user, rank, item) ranked once at max K; ``relevant``
    (user, item); ``users`` (user, n_relevant) are the evaluated users — a
    user without recommendations counts with precision = recall = 0.
    ``models`` names the models; left out, they are read from ``recs``."""
    rel = relevant.select(user, item).withColumn("_hit", F.lit(1))
    r = recs.join(rel, [user, item], "left")
    aggs = []
    for k in ks:
        in_k = F.col("rank") <= k
        aggs += [
            F.sum(F.when(in_k & F.col("_hit").isNotNull(), 1).otherwise(0)).alias(f"_h{k}"),
            F.sum(F.when(in_k, 1).otherwise(0)).alias(f"_n{k}"),
        ]
    per = r.groupBy(model_col, user).agg(*aggs)
    if models is None:
        models = sorted(r[0] for r in recs.select(model_col).distinct().collect())  # a handful of names
    # every (model, evaluated user)
    grid = users.select(user, "n_relevant", F.explode(F.array(*[F.lit(m) for m in models]).cast("array<string>")).alias(model_col))
    full = grid.join(per, [model_col, user], "left").fillna(0)
    rows = []
    for k in ks:
        rows.append(
            F.struct(
                F.lit(k).alias("k"),
                safe_ratio(F.col(f"_h{k}"), F.col(f"_n{k}")).alias("p"),
                safe_ratio(F.col(f"_h{k}"), F.col("n_relevant")).alias("r"),
            )
        )
    long = full.select(model_col, user, F.explode(F.array(*rows)).alias("_m")).select(model_col, user, "_m.*")
    means = long.groupBy(model_col, "k").agg(
        F.count(F.lit(1)).alias("n_users"), F.avg("p").alias("precision"), F.avg("r").alias("recall")
    )
    return means.select(
        model_col, "k", "n_users",
        F.round("precision", 6).alias("precision"),
        F.round("recall", 6).alias("recall"),
        F.round(f1("precision", "recall"), 6).alias("f1"),
    )


def coverage(recs: DataFrame, n_items: DataFrame, k: int = 10, item: str = "merchant_id", model_col: str = "model") -> DataFrame:
    """Distinct items in the top-k lists / catalogue size, per model.
    ``n_items`` is a one-row (n_items) table."""
    c = recs.where(F.col("rank") <= k).groupBy(model_col).agg(F.countDistinct(item).alias("_d"))
    one_row = F.broadcast(n_items.withColumn("_one", F.lit(1)))
    return c.withColumn("_one", F.lit(1)).join(one_row, "_one").select(
        model_col, F.round(safe_ratio("_d", "n_items"), 6).alias("coverage")
    )


def list_diversity(recs: DataFrame, ix: DataFrame, k: int = 10, user: str = "client_id", item: str = "merchant_id",
                   value: str = "transaction_count", model_col: str = "model") -> DataFrame:
    """(model, n_users, diversity).  A list's diversity is the mean of
    1 − cosine over its pairs of items at ranks up to ``k``; a model's is the
    mean over its lists of two items or more.

    Only pairs that stand in a list are compared (``pair_similarity`` over
    the interactions ``ix``).  A pair first adds up what it weighs in all
    lists of a model, so that the pairs of the most popular items, which are
    in nearly every list, meet their similarity once."""
    lists = recs.where(F.col("rank") <= k).groupBy(model_col, user).agg(F.array_sort(F.collect_set(item)).alias("_l"))
    lists = lists.where(F.size("_l") > 1)  # at most k items each
    couple = lambda x, i: F.transform(F.slice("_l", i + 2, F.lit(k)), lambda y: F.struct(x.alias("_a"), y.alias("_b")))
    n_pairs = F.size("_l") * (F.size("_l") - 1) / 2
    pairs = lists.select(model_col, (1 / n_pairs).alias("_w"), F.explode(F.flatten(F.transform("_l", couple))).alias("_p"))
    weights = pairs.groupBy(model_col, "_p._a", "_p._b").agg(F.sum("_w").alias("_w"))
    sims = pair_similarity(weights, ix, "_a", "_b", item, user, value)
    total = weights.join(sims, ["_a", "_b"]).groupBy(model_col).agg(F.sum(F.col("_w") * (1 - F.col("sim"))).alias("_d"))
    n = lists.groupBy(model_col).agg(F.count(F.lit(1)).alias("n_users"))
    return n.join(total, model_col).select(model_col, "n_users", F.round(F.col("_d") / F.col("n_users"), 6).alias("diversity"))


def metrics_long(ranking: DataFrame, cov: DataFrame | None = None, errors: DataFrame | None = None,
                 model_col: str = "model", diversity: DataFrame | None = None) -> DataFrame:
    """(model, metric, k, value) from the per-K table, coverage, RMSE/MAE and diversity."""
    none = F.lit(None).cast("int")

    def long(df: DataFrame, names: tuple[str, ...], k) -> DataFrame:
        items = [F.struct(F.lit(m).alias("metric"), k.alias("k"), F.col(m).cast("double").alias("value")) for m in names]
        return df.select(model_col, F.explode(F.array(*items)).alias("_m")).select(model_col, "_m.*")

    parts = [long(ranking, ("precision", "recall", "f1"), F.col("k").cast("int"))]
    if cov is not None:
        parts.append(long(cov, ("coverage",), none))
    if errors is not None:
        parts.append(long(errors, ("rmse", "mae"), none))
    if diversity is not None:
        parts.append(long(diversity, ("diversity",), none))
    return reduce(lambda a, b: a.unionByName(b), parts)


COMPARE_COLUMNS = [
    ("rmse", None), ("mae", None), ("precision", 5), ("precision", 10), ("recall", 5), ("recall", 10),
    ("f1", 5), ("f1", 10), ("coverage", None),
]


def _col_name(metric: str, k: int | None) -> str:
    return metric if k is None else f"{metric}_{k}"


def compare_models(metrics: DataFrame, model_col: str = "model", formatted: bool = False) -> DataFrame:
    """One row per model, fixed columns, missing = null (or 'N/A' text
    with ``formatted``).  A pivot over a fixed column list."""
    names = [_col_name(m, k) for m, k in COMPARE_COLUMNS]
    keyed = metrics.select(
        model_col,
        F.when(F.col("k").isNull(), F.col("metric")).otherwise(F.concat_ws("_", "metric", F.col("k").cast("string"))).alias("_c"),
        "value",
    ).where(F.col("_c").isin(names))
    p = keyed.groupBy(model_col).pivot("_c", names).agg(F.first("value"))
    if formatted:
        p = p.select(model_col, *[fixed4_or_na(c).alias(c) for c in names])
    return p


def best_by_metric(metrics: DataFrame, model_col: str = "model") -> DataFrame:
    """Best model per metric (min for RMSE/MAE, max otherwise); missing
    values ignored; ties go to the smaller model name."""
    m = metrics.where(F.col("value").isNotNull()).withColumn(
        "_key", F.when(F.col("metric").isin(*LOWER_IS_BETTER), F.col("value")).otherwise(-F.col("value"))
    )
    w = Window.partitionBy("metric", "k").orderBy(F.col("_key").asc(), F.col(model_col).asc())
    return m.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).select(
        "metric", "k", F.col(model_col).alias("best_model"), F.col("value").alias("best_value")
    )


def metric_series(metrics: DataFrame, metric: str, models: list[str], model_col: str = "model") -> DataFrame:
    """One metric by K with one column for each of ``models`` (chart input)."""
    rows = metrics.where((F.col("metric") == metric) & F.col("k").isNotNull())
    return rows.groupBy("k").pivot(model_col, sorted(models)).agg(F.first("value"))
