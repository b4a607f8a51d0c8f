"""Golden values of FIXTURES.md §3 (computed independently with NumPy)."""

import numpy as np
import pytest
from pyspark.sql import functions as F


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_cleaning(micro_tx):
    got = {r.id: r for r in micro_tx.collect()}
    assert got[2].amount == 1234.56 and got[4].amount == -77.0
    assert got[6].amount_category is None
    assert got[1].amount_category == "Very Low" and got[3].amount_category == "Low"
    assert got[4].amount_category == "Medium" and got[7].amount_category == "High"
    assert got[8].amount_category == "High" and got[2].amount_category == "Very High"
    assert [got[i].day_of_week for i in range(1, 12)] == [4, 4, 5, 6, 0, 3, 4, 4, 0, 1, 2]
    assert [got[i].hour for i in range(1, 12)] == [0, 9, 12, 13, 8, 8, 23, 10, 11, 11, 11]
    assert {i for i in got if got[i].is_fraud == 1} == {2, 7}
    assert got[8].mcc_description is None and got[1].mcc_description == "Grocery Stores, Supermarkets"


def test_interactions(micro_ix):
    got = sorted(rows(micro_ix, "client_id", "merchant_id", "transaction_count"))
    assert got == [(10, 100, 2), (10, 101, 1), (20, 100, 1), (20, 101, 1), (20, 102, 1),
                   (30, 102, 1), (30, 103, 1), (40, 103, 2), (40, 104, 1)]


def test_matrix_stats(micro_ix):
    from tillrec.operators.interactions import matrix_stats

    r = matrix_stats(micro_ix).first()
    assert (r.n_users, r.n_items, r.nnz) == (4, 5, 9)
    assert r.sparsity == pytest.approx(0.55)


def test_ratings(micro_tx):
    from tillrec.operators.interactions import ratings

    got = {(r.client_id, r.merchant_id): r.rating for r in ratings(micro_tx).collect()}
    exp = {(10, 100): 4.115583, (10, 101): 5.0, (20, 100): 3.447837, (20, 101): 1.0, (20, 102): 3.209114,
           (30, 102): 4.492829, (30, 103): 3.593082, (40, 103): 4.293809, (40, 104): 2.441129}
    for k, v in exp.items():
        assert got[k] == pytest.approx(v, abs=1e-6)


def test_cosine(micro_ix):
    from tillrec.operators.similarity import item_similarity, user_similarity

    us = {(r.user_a, r.user_b): r.sim for r in user_similarity(micro_ix).collect()}
    assert us == pytest.approx({(10, 20): 0.774597, (20, 30): 0.408248, (30, 40): 0.632456}, abs=1e-6)
    it = {(r.item_a, r.item_b): r.sim for r in item_similarity(micro_ix).collect()}
    assert it == pytest.approx({(100, 101): 0.948683, (100, 102): 0.316228, (101, 102): 0.5,
                                (102, 103): 0.316228, (103, 104): 0.894427}, abs=1e-6)


def test_cosine_salting_is_exact(micro_ix):
    """Cutting every group into chunks (heavy_degree=1) must not change a pair."""
    from tillrec.operators.similarity import item_similarity, user_similarity

    for f in (user_similarity, item_similarity):
        a = sorted(tuple(r) for r in f(micro_ix).collect())
        b = sorted(tuple(r) for r in f(micro_ix, heavy_degree=1).collect())
        c = sorted(tuple(r) for r in f(micro_ix, heavy_degree=None).collect())
        assert a == b == c


def _recs(df):
    out = {}
    for r in df.orderBy("client_id", "rank").collect():
        out.setdefault(r.client_id, []).append((r.merchant_id, round(r.score, 6)))
    return out


def test_user_based(micro_ix):
    from tillrec.operators.neighbors import recommend_user_based

    got = _recs(recommend_user_based(micro_ix))
    assert got == {10: [(102, 1.0)], 20: [(103, 1.0)], 30: [(100, 1.0), (101, 1.0), (104, 1.0)], 40: [(102, 1.0)]}


def test_item_based(micro_ix):
    from tillrec.operators.neighbors import recommend_item_based

    got = _recs(recommend_item_based(micro_ix))
    assert got == {10: [(102, 1.387426)], 20: [(103, 1.0)], 30: [(100, 1.0), (101, 1.0), (104, 1.0)], 40: [(102, 2.0)]}


def test_popular(micro_ix):
    from tillrec.operators.neighbors import recommend_popular

    got = {u: [m for m, _ in v] for u, v in _recs(recommend_popular(micro_ix, n=2)).items()}
    assert got == {10: [103, 102], 20: [103, 104], 30: [100, 101], 40: [100, 101]}


def test_long_tail(spark, micro_tx):
    from tillrec.operators.analytics import long_tail, share_at_rank

    got = [(r.merchant_id, r.cum_share) for r in long_tail(micro_tx).orderBy("rank").collect()]
    assert got == [(100, 0.272727), (103, 0.545455), (101, 0.727273), (102, 0.909091), (104, 1.0)]
    assert share_at_rank(micro_tx).first().share_at_rank == 0.545455


def test_histogram(spark, micro_tx):
    from tillrec.operators.analytics import histogram

    h = histogram(spark, micro_tx, "amount", 5, clip_range=(-1000.0, 1000.0)).orderBy("bin").collect()
    assert [r.n for r in h] == [9, 0, 1, 0, 1]
    assert [r.bin_lo for r in h] == [-77.0, 138.4, 353.8, 569.2, 784.6]
    assert h[-1].bin_hi == 1000.0


def test_svd_matches_numpy(spark, micro_tx):
    from tillrec.operators.factors import fit_svd, predict
    from tillrec.operators.interactions import ratings

    r = ratings(micro_tx)
    m = fit_svd(r, k=4)
    assert m.sigma == pytest.approx([7.611252, 6.630674, 4.222225, 1.700441], abs=1e-5)
    m2 = fit_svd(r, k=2)
    assert m2.explained_variance_ratio == pytest.approx(0.700580, abs=1e-5)
    pred = predict(m2, r)
    d = pred.agg(F.sqrt(F.avg((F.col("rating") - F.col("prediction")) ** 2)), F.avg(F.abs(F.col("rating") - F.col("prediction")))).first()
    assert d[0] == pytest.approx(1.055499, abs=1e-5)
    assert d[1] == pytest.approx(0.984869, abs=1e-5)


def test_nmf_objective_decreases(spark, micro_tx):
    from tillrec.operators.factors import fit_nmf, nmf_objective_trace
    from tillrec.operators.interactions import ratings

    r = ratings(micro_tx)
    trace = nmf_objective_trace(r, k=2, iters=4)
    assert all(b <= a + 1e-9 for a, b in zip(trace, trace[1:]))
    m = fit_nmf(r, k=2, max_iter=20, tol=0.0, check_every=0)
    for t in (m.users, m.items):
        assert t.where(" OR ".join(f"f{j} < 0" for j in range(2))).count() == 0
    # reconstruction identity against a dense NumPy product
    w = {x.key: [x.f0, x.f1] for x in m.users.collect()}
    h = {x.key: [x.f0, x.f1] for x in m.items.collect()}
    users, items = sorted(w), sorted(h)
    X = np.zeros((len(users), len(items)))
    for x in r.collect():
        X[users.index(x.client_id), items.index(x.merchant_id)] = x.rating
    Wm = np.array([w[u] for u in users])
    Hm = np.array([h[i] for i in items]).T
    assert m.reconstruction_err == pytest.approx(np.linalg.norm(X - Wm @ Hm), rel=1e-9)


def test_ranking_metrics(spark):
    from tillrec.operators.evaluate import ranking_metrics

    recs = spark.createDataFrame(
        [("m", 1, r, i) for r, i in enumerate([9, 2, 8, 3, 7], 1)] + [("m", 2, r, i) for r, i in enumerate([4, 5], 1)],
        "model string, client_id bigint, rank int, merchant_id bigint",
    )
    rel = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 4)], "client_id bigint, merchant_id bigint")
    users = spark.createDataFrame([(1, 3), (2, 1)], "client_id bigint, n_relevant bigint")
    got = {r.k: r for r in ranking_metrics(recs, rel, users, (5, 10)).collect()}
    for k in (5, 10):
        assert got[k].precision == pytest.approx(0.45)
        assert got[k].recall == pytest.approx(0.833333, abs=1e-6)
        assert got[k].f1 == pytest.approx(0.584416, abs=1e-6)


def test_best_by_metric(spark):
    """FIXTURES §3.4 on the published comparison table (N/A ignored)."""
    from tillrec.operators.evaluate import best_by_metric

    cf, svd, nmf = "Collaborative Filtering", "SVD", "NMF"
    table = {
        cf: [None, None, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.00468384074941452],
        svd: [0.2443949994304115, 0.16441273145660817, 0.09333333333333334, 0.05666666666666667, 0.1911111111111111,
              0.2061111111111111, 0.12541666666666668, 0.08889358703312192, 0.0],
        nmf: [0.24440960638334583, 0.16441642865459072, 0.12413793103448276, 0.04827586206896553, 0.27586206896551724,
              0.2011494252873563, 0.1712247324613555, 0.07786429365962182, 0.0],
    }
    cols = [("rmse", None), ("mae", None), ("precision", 5), ("precision", 10), ("recall", 5), ("recall", 10),
            ("f1", 5), ("f1", 10), ("coverage", None)]
    data = [(m, c, k, v) for m, vals in table.items() for (c, k), v in zip(cols, vals)]
    metrics = spark.createDataFrame(data, "model string, metric string, k int, value double")
    got = {(r.metric, r.k): r.best_model for r in best_by_metric(metrics).collect()}
    assert got[("rmse", None)] == svd and got[("mae", None)] == svd
    assert got[("precision", 5)] == nmf and got[("recall", 5)] == nmf and got[("f1", 5)] == nmf
    assert got[("precision", 10)] == svd and got[("recall", 10)] == svd and got[("f1", 10)] == svd
    assert got[("coverage", None)] == cf
