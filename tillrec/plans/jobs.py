"""Stage jobs — the batch entry points replacing the reference's step runner.

    python -m tillrec.plans.jobs ingest    --input CSV --out DIR
    python -m tillrec.plans.jobs prepare   --input DIR --out DIR
    python -m tillrec.plans.jobs recommend --input DIR --out DIR
    python -m tillrec.plans.jobs factors   --input DIR --out DIR
    python -m tillrec.plans.jobs evaluate  --input DIR --out DIR
    python -m tillrec.plans.jobs all       --input DIR --out DIR

``--input`` is a folder of the driver's parquet tables (the adapters map them
onto the canonical schema).  Every stage reads whole tables; ``--limit``
(off by default) is the reference's optional first-N-rows cap.  Each stage
writes its outputs as tables, so later stages start from written data.
"""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession

from ..operators import analytics as AN
from ..operators import evaluate as EV
from ..operators import factors as FA
from ..operators import interactions as IN
from ..operators import neighbors as NB
from ..operators.clean import clean_transactions, merchant_info
from ..sources import rejects as RJ
from ..sources import sinks as SK
from ..sources.readers import head_sample
from ..session import ensure_checkpoint_dir
from . import base
from . import evaluation as EVP


def ingest(spark: SparkSession, inp: str, out: str) -> dict:
    """Checked scan of transaction CSVs: cleaned transactions and, beside
    them, the records that could not be read, with reasons."""
    checked = RJ.read_checked(spark, inp)
    return RJ.write_checked(checked, f"{out}/transactions", f"{out}/rejected_transactions", clean_transactions)


def prepare(spark: SparkSession, inp: str, out: str, limit: int | None = None) -> dict:
    """Day 1: clean, interaction tables, pivots, summary."""
    tx = head_sample(base.tx(spark, inp), limit, ["date", "id", "client_id", "merchant_id"])
    SK.write_transactions(tx, f"{out}/transactions").write.mode("overwrite").parquet(f"{out}/transactions_profile")
    tx = spark.read.parquet(f"{out}/transactions")
    ix = IN.interactions(tx)
    SK.write_interactions(ix, f"{out}/user_merchant_interactions")
    SK.write_interactions(IN.category_interactions(tx), f"{out}/user_mcc_interactions")
    SK.write_matrix(IN.pair_counts(tx, item="mcc"), f"{out}/user_mcc_matrix", "client_id", "mcc", "count")
    return AN.dataset_summary(tx).first().asDict()


def recommend(spark: SparkSession, inp: str, out: str) -> dict:
    """Day 2: user-based and item-based CF for every user, enriched."""
    tx = spark.read.parquet(f"{out}/transactions")
    ix = base.visits(tx)
    info = merchant_info(tx)
    NB.enrich(NB.recommend_user_based(ix), info).write.mode("overwrite").parquet(f"{out}/recs_user_based")
    NB.enrich(NB.recommend_item_based(ix), info).write.mode("overwrite").parquet(f"{out}/recs_item_based")
    AN.user_profile(tx).write.mode("overwrite").parquet(f"{out}/user_profiles")
    return {"users": ix.select("client_id").distinct().count()}


def factors(spark: SparkSession, inp: str, out: str, k: int = 30) -> dict:
    """Day 3: ratings, split, SVD and NMF, top-N and factor reports."""
    tx = spark.read.parquet(f"{out}/transactions")
    r = IN.ratings(tx)
    info = merchant_info(tx)
    res = {}
    seen, items = r.select("client_id", "merchant_id"), r.select("merchant_id")
    for name, m in (("svd", FA.fit_svd(r, k=k)), ("nmf", FA.fit_nmf(r, k=k))):
        FA.factor_top_items(m, 5, 5, info).write.mode("overwrite").parquet(f"{out}/factors_{name}_top_items")
        FA.recommend_factors(m, seen, items, info=info).write.mode("overwrite").parquet(f"{out}/recs_{name}")
        res[name] = {"k": m.k, "explained_variance_ratio": m.explained_variance_ratio,
                     "reconstruction_err": m.reconstruction_err}
    return res


def evaluate(spark: SparkSession, inp: str, out: str, k: int = 20) -> dict:
    """Day 4: one holdout, all models, metrics, comparison, best model."""
    tx = spark.read.parquet(f"{out}/transactions")
    ix = base.visits(tx)
    cf = EVP.cf_metrics(EVP.cf_run(ix))[2]
    run = EVP.mf_run(IN.ratings(tx), k=k)
    mf_rank = EV.ranking_metrics(run.eval.recs, run.eval.relevant, run.eval.users, models=run.eval.models)
    EVP.mf_errors(run).write.mode("overwrite").parquet(f"{out}/factor_errors")
    mf = EV.metrics_long(mf_rank, EV.coverage(run.eval.recs, run.eval.n_items), EVP.mf_errors(run))
    metrics = cf.unionByName(mf)
    metrics.write.mode("overwrite").parquet(f"{out}/metrics")
    metrics = spark.read.parquet(f"{out}/metrics")
    SK.write_evaluation_results(metrics, f"{out}/evaluation_results")
    SK.write_model_comparison(metrics, f"{out}/model_comparison")
    best = EV.best_by_metric(metrics)
    return {f"{r.metric}@{r.k}" if r.k else r.metric: r.best_model for r in best.collect()}  # few rows


STAGES = {"prepare": prepare, "recommend": recommend, "factors": factors, "evaluate": evaluate}


def main(argv=None) -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("stage", choices=["ingest", *STAGES, "all"])
    ap.add_argument("--input", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--limit", type=int, default=None)
    a = ap.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    todo = list(STAGES) if a.stage == "all" else [a.stage]
    for name in todo:
        t0 = time.time()
        run = {"ingest": ingest, **STAGES}[name]
        res = run(spark, a.input, a.out, a.limit) if name == "prepare" else run(spark, a.input, a.out)
        print(json.dumps({"stage": name, "seconds": round(time.time() - t0, 1), "result": res}, default=str))


if __name__ == "__main__":
    main()

