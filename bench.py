"""Headline-query benchmark.

Runs the flagship jobs on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1)
with ``local[$BENCH_CPUS]`` and prints one JSON line.  Every query is
executed in full through the ``noop`` sink (nothing is collected); the fits
are timed end to end.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tillrec.operators import factors as FA  # noqa: E402
from tillrec.operators import interactions as IN  # noqa: E402
from tillrec.plans import base  # noqa: E402
from tillrec.plans import catalog  # noqa: E402
from tillrec.session import local_session, reliable  # noqa: E402

HEADLINE = [
    "c01_clean_transactions",
    "b04_describe_numeric",
    "f02_item_index",
    "d01_interactions",
    "d27_user_profile",
    "w01_long_tail",
    "e01_user_similarity",
    "e02_item_similarity",
    "e05_recommend_user_based",
    "e06_recommend_item_based",
    "e07_recommend_popular",
    "g04_ranking_metrics",
]


def run_noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = local_session(cpus, shuffle_partitions=max(8, int(cpus) * 2) if cpus.isdigit() else 16, app="tillrec-bench")
    # warm-up: JVM, Python workers, parquet footers
    run_noop(catalog.QUERIES["d21_merchant_popularity"](spark, sf_dir))
    times: dict[str, float] = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        t0 = time.time()
        run_noop(catalog.QUERIES[name](spark, sf_dir))
        times[name] = round(time.time() - t0, 3)
    if not only or {"f06_svd_fit", "f08_nmf_fit", "f12_recommend_factors"} & set(only):
        ratings = reliable(IN.ratings(base.tx_plain(spark, sf_dir)))
        t0 = time.time()
        svd = FA.fit_svd(ratings, k=30)
        times["f06_svd_fit"] = round(time.time() - t0, 3)
        if not only or "f08_nmf_fit" in only:
            t0 = time.time()
            m = FA.fit_nmf(ratings, k=30)
            times["f08_nmf_fit"] = round(time.time() - t0, 3)
            times["f08_nmf_iterations"], times["f08_nmf_converged"] = m.n_iter, m.converged
        if not only or "f12_recommend_factors" in only:
            t0 = time.time()
            run_noop(FA.recommend_factors(svd, ratings.select("client_id", "merchant_id"), ratings.select("merchant_id")))
            times["f12_recommend_factors"] = round(time.time() - t0, 3)
    total = round(sum(v for k, v in times.items() if not k.endswith(("_iterations", "_converged"))), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_wall", "value": total, "unit": "sec", "queries": times, "sf": sf,
                      "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
