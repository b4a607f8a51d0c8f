"""Evaluation jobs composed from the operators (survey 3.3, G4-G12).

``cf_run`` draws the holdout once, trains the neighbourhood and popularity
models on the remaining interactions and ranks every evaluated user once at
the largest K.  ``mf_run`` does the same for the latent-factor models on the
rating split (F5).  Both return long tables that the metric operators consume.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate as EV
from ..operators import factors as FA
from ..operators import neighbors as NB
from ..session import reliable

CF_MODELS = ("popularity", "user_based", "item_based")


@dataclass
class EvalRun:
    recs: DataFrame  # (model, client_id, rank, merchant_id, score)
    relevant: DataFrame  # (client_id, merchant_id)
    users: DataFrame  # (client_id, n_relevant)
    n_items: DataFrame  # one row (n_items)
    models: list[str]
    train: DataFrame  # interactions outside the holdout


def cf_run(ix: DataFrame, n: int = max(EV.KS), divisor: int = 3, min_items: int = 3, models=CF_MODELS,
           salt: str = "holdout") -> EvalRun:
    # written once: every model reads it several times
    split = reliable(EV.holdout_per_user(ix, divisor=divisor, min_items=min_items, salt=salt))
    train = split.where(~F.col("is_holdout")).select("client_id", "merchant_id", "transaction_count")
    relevant = split.where(F.col("is_holdout")).select("client_id", "merchant_id")
    users = relevant.groupBy("client_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    builders = {
        "popularity": lambda: NB.recommend_popular(train, users=users, n=n),
        "user_based": lambda: NB.recommend_user_based(train, users=users, n=n),
        "item_based": lambda: NB.recommend_item_based(train, users=users, n=n),
    }
    parts = [builders[m]().withColumn("model", F.lit(m)) for m in models]
    recs = reduce(lambda a, b: a.unionByName(b), parts).select("model", "client_id", "rank", "merchant_id", "score")
    # the short lists are written once; every metric reads them from there
    recs = reliable(recs)
    n_items = split.agg(F.countDistinct("merchant_id").alias("n_items"))
    return EvalRun(recs, relevant, users, n_items, list(models), train)


def cf_metrics(run: EvalRun, ks=EV.KS) -> tuple[DataFrame, DataFrame, DataFrame]:
    ranking = EV.ranking_metrics(run.recs, run.relevant, run.users, ks, models=run.models)
    cov = EV.coverage(run.recs, run.n_items, 10)
    return ranking, cov, EV.metrics_long(ranking, cov)


@dataclass
class MFRun:
    models: dict[str, FA.FactorModel]
    test_pred: DataFrame  # (model, client_id, merchant_id, rating, prediction, raw_prediction)
    eval: EvalRun


def mf_run(ratings: DataFrame, k: int = 20, n: int = max(EV.KS), nmf_iter: int = 500, divisor: int = 3,
           models=("svd", "nmf"), min_items: int = 3, salt: str = "holdout", seed: int = 42) -> MFRun:
    """Fit SVD and NMF on the ratings outside the per-user holdout that
    ``cf_run`` draws too, so all models share training pairs, evaluated users
    and relevant items.  The held-out ratings are predicted (RMSE/MAE), and
    each evaluated user's items without a training rating are ranked."""
    ratings = ratings.select("client_id", "merchant_id", "rating")
    split = reliable(EV.holdout_per_user(ratings, divisor=divisor, min_items=min_items, salt=salt))
    train = split.where(~F.col("is_holdout"))
    test = split.where(F.col("is_holdout")).select("client_id", "merchant_id", "rating")
    if {"svd", "nmf"} & set(models):
        size = split.agg(F.countDistinct("client_id").alias("u"), F.countDistinct("merchant_id").alias("i")).first()
    fitted: dict[str, FA.FactorModel] = {}
    if "svd" in models:
        fitted["svd"] = FA.fit_svd(train, k=k, n_users=size["u"], seed=seed)
    if "nmf" in models:
        fitted["nmf"] = FA.fit_nmf(train, k=k, max_iter=nmf_iter, n_users=size["u"], n_items=size["i"], seed=seed)
    if "als" in models:
        fitted["als"] = FA.fit_als(train, k=k, seed=seed)
    preds = [FA.predict(m, test).withColumn("model", F.lit(name)) for name, m in fitted.items()]
    test_pred = reduce(lambda a, b: a.unionByName(b), preds)
    users = test.groupBy("client_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    visited = train.select("client_id", "merchant_id")
    catalogue = split.select("merchant_id").distinct()
    recs = reduce(
        lambda a, b: a.unionByName(b),
        [
            FA.recommend_factors(m, visited, catalogue, users=users, n=n).withColumn("model", F.lit(name))
            for name, m in fitted.items()
        ],
    ).select("model", "client_id", "rank", "merchant_id", "score")
    n_items = split.agg(F.countDistinct("merchant_id").alias("n_items"))
    return MFRun(fitted, test_pred, EvalRun(reliable(recs), test, users, n_items, list(fitted), train))


def mf_errors(run: MFRun) -> DataFrame:
    """F11 per model: (model, rmse, mae, n)."""
    d = F.col("rating") - F.col("prediction")
    return run.test_pred.groupBy("model").agg(
        F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), F.count(F.lit(1)).alias("n")
    )
