"""Latent-factor operators against NumPy; evaluation runs share one split."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tillrec.operators import factors as FA


@pytest.fixture(scope="module")
def dense():
    rng = np.random.default_rng(3)
    part = lambda: rng.random((200, 6)) * (rng.random((200, 6)) < 0.5)
    x = part() @ np.diag([50, 40, 30, 20, 10, 1e-3]) @ part().T
    x[:, 7] = x[:, 3] * (1 + 1e-7)  # nearly dependent columns
    return x


@pytest.fixture(scope="module")
def ratings(spark, dense):
    rows = [(u, i, float(dense[u, i])) for u, i in zip(*np.nonzero(dense))]
    return spark.createDataFrame([(int(u), int(i), x) for u, i, x in rows], "client_id bigint, merchant_id bigint, rating double").cache()


def table(df, k, n):
    out = np.zeros((n, k))
    for r in df.collect():
        out[r["key"]] = [r[f"f{j}"] for j in range(k)]
    return out


@pytest.fixture(scope="module")
def svd(ratings):
    return FA.fit_svd(ratings, k=5)


def test_svd_equals_numpy(svd, dense):
    s = np.linalg.svd(dense, compute_uv=False)[:5]
    assert np.allclose(svd.sigma, s, rtol=1e-3)
    v = table(svd.items, 5, 200)
    assert np.allclose(v.T @ v, np.eye(5), atol=1e-8)
    assert np.allclose(table(svd.users, 5, 200), dense @ v, atol=1e-6)


def test_products_are_the_same_by_shuffle(svd, ratings, monkeypatch):
    """Factor tables above the broadcast bound."""
    monkeypatch.setattr(FA, "BROADCAST_FACTOR_BYTES", 0)
    assert np.allclose(FA.fit_svd(ratings, k=5).sigma, svd.sigma, rtol=1e-6)
    assert np.isfinite(FA.fit_nmf(ratings, k=2, max_iter=2).reconstruction_err)


def test_factors_of_many_users_stay_off_the_driver(spark, ratings):
    """900,000 users by 30 columns (216 MB) were broadcast; and X itself moves in no product."""
    mx = FA._Matrix(ratings, "client_id", "merchant_id", "rating")
    mx.n[FA.U] = 900_000
    cols = FA.fcols("f", 30)
    fac = mx.keys(FA.U).select("key", *[F.lit(1.0).alias(c) for c in cols])
    plan = mx.product(FA.U, FA.I, fac, cols, cols)._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    assert "BroadcastHashJoin" not in plan and "BroadcastExchange" not in plan
    got = {r["key"]: r["f29"] for r in mx.product(FA.U, FA.I, fac, cols, cols).collect()}
    want = {r["merchant_id"]: r["s"] for r in ratings.groupBy("merchant_id").agg(F.sum("rating").alias("s")).collect()}
    mx.release()
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 * abs(want[k]) for k in want)


def test_nmf_converges(ratings, dense):
    m = FA.fit_nmf(ratings, k=4)
    w, h = table(m.users, 4, 200), table(m.items, 4, 200)
    err = np.linalg.norm(dense - w @ h.T)
    assert m.converged and m.n_iter < 500 and abs(err - m.reconstruction_err) < 1e-6 * err
    best = np.sqrt((np.linalg.svd(dense, compute_uv=False)[4:] ** 2).sum())
    assert (w >= 0).all() and (h >= 0).all() and err < 1.1 * best
    refit = table(FA.fold_in(m, ratings), 4, 200)
    grad = (refit @ (h.T @ h) - dense @ h) * (refit > 0)
    assert np.abs(grad).max() < 0.05 * np.abs(dense @ h).max()


def test_svd_of_an_ill_conditioned_matrix(spark):
    """Singular values over twelve orders of magnitude, and one rank fewer than asked for."""
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import RowMatrix

    rng = np.random.default_rng(11)
    q = lambda: np.linalg.qr(rng.standard_normal((200, 7)))[0]
    s = np.array([1e6, 1e4, 1e2, 1.0, 1e-2, 1e-4, 1e-6])
    x = q() @ np.diag(s) @ q().T
    rows = [(int(u), int(i), float(x[u, i])) for u in range(200) for i in range(200)]
    df = spark.createDataFrame(rows, "client_id bigint, merchant_id bigint, rating double").repartition(7)
    m = FA.fit_svd(df, k=7, n_oversamples=0, n_iter=2)
    assert np.allclose(m.sigma[:6], s[:6], rtol=1e-5)
    v = table(m.items, 7, 200)
    assert np.allclose(v[:, :6].T @ v[:, :6], np.eye(6), atol=1e-6)
    ref = RowMatrix(spark.sparkContext.parallelize([Vectors.dense(r) for r in x.tolist()], 4)).computeSVD(3).s
    assert np.allclose(m.sigma[:3], ref.toArray(), rtol=1e-6)


def test_triangle_is_the_same_in_any_partitioning(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 4))
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "key int, f0 double, f1 double, f2 double, f3 double")
    want = np.linalg.qr(x, mode="r")
    monkeypatch.setattr(FA, "FAN_IN", 2)
    for parts in (1, 9):
        got = FA._triangle(df.repartition(parts), FA.fcols("f", 4))
        assert np.allclose(np.abs(got), np.abs(want), rtol=1e-10)


def test_als_rows_are_stationary(spark):
    """Every user's factors minimise the observed squared error plus the weighted penalty under f >= 0."""
    rng = np.random.default_rng(4)
    w, h = rng.random((40, 3)), rng.random((30, 3))
    cells = [(u, i) for u in range(40) for i in range(30) if rng.random() < 0.5]
    rows = [(1000 + u, 7 * i, float(w[u] @ h[i]) + 1) for u, i in cells]
    df = spark.createDataFrame(rows, "client_id bigint, merchant_id bigint, rating double")
    reg = 0.02
    m = FA.fit_als(df, k=3, max_iter=15, reg=reg, blocks=2)
    f = lambda t: {r["key"]: np.array([r["f0"], r["f1"], r["f2"]]) for r in t.collect()}
    users, items = f(m.users), f(m.items)
    assert set(users) == {r[0] for r in rows} and set(items) == {r[1] for r in rows}
    err = 0.0
    for u, a in users.items():
        mine = [(items[i], x) for v, i, x in rows if v == u]
        g = sum((a @ b - x) * b for b, x in mine) + reg * len(mine) * a
        assert (a >= 0).all() and (g > -1e-2).all() and np.abs(g * (a > 1e-6)).max() < 1e-2
        err += sum((a @ b - x) ** 2 for b, x in mine)
    assert abs(np.sqrt(err) - m.reconstruction_err) < 1e-6 and m.reconstruction_err / np.sqrt(len(rows)) < 0.1


@pytest.mark.parametrize("blocks", [{}, {"user_block": 30, "item_block": 17}, {"item_block": 40, "step": 8}])
def test_top_n_equals_numpy(spark, svd, ratings, dense, blocks):
    score = np.round(table(svd.users, 5, 200) @ table(svd.items, 5, 200).T, 9)
    score[dense != 0] = -np.inf
    score[:, ~(dense != 0).any(axis=0)] = -np.inf  # never rated: not in the catalogue
    info = spark.createDataFrame([(i, "c", "s", i, None if i % 2 else "cat") for i in range(200)], "merchant_id bigint, merchant_city string, merchant_state string, mcc int, mcc_description string")
    top = FA.recommend_factors(svd, ratings, ratings, n=10, info=info, **blocks)
    got = {}
    for r in top.orderBy("client_id", "rank").collect():
        got.setdefault(r["client_id"], []).append(r["merchant_id"])
        assert r["mcc_description"] == ("Unknown Category" if r["merchant_id"] % 2 else "cat")
    for u in np.flatnonzero((dense != 0).any(axis=1)).tolist():
        order = np.lexsort((np.arange(200), -score[u]))[:10]
        assert got.get(u, []) == order[score[u][order] > -np.inf].tolist()
    assert top.join(ratings, ["client_id", "merchant_id"], "left_semi").count() == 0


def test_few_products_are_formed_where_norms_fall(spark):
    """Falling item norms: most blocks cannot reach the tenth score."""
    rng = np.random.default_rng(8)
    h = rng.standard_normal((400, 3)) * (0.97 ** np.arange(400))[:, None]
    w = rng.standard_normal((50, 3))
    as_table = lambda x: spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "key bigint, f0 double, f1 double, f2 double")
    model = FA.FactorModel("svd", 3, as_table(w), as_table(h))
    users = spark.range(50).select(F.col("id").alias("client_id"))
    seen = users.withColumn("merchant_id", F.col("client_id") % 20)
    items = spark.range(400).select(F.col("id").alias("merchant_id"))
    kw = {"n": 5, "item_block": 50, "step": 10}
    score = np.round(w @ h.T, 9)
    score[np.arange(50), np.arange(50) % 20] = -np.inf
    got = {}
    for r in FA.recommend_factors(model, seen, items, **kw).orderBy("client_id", "rank").collect():
        got.setdefault(r["client_id"], []).append(r["merchant_id"])
    assert got == {u: np.lexsort((np.arange(400), -score[u]))[:5].tolist() for u in range(50)}
    work = FA.recommend_factors(model, seen, items, scored=True, **kw).toPandas()
    assert (work.dense == 50 * 400).all() and work.scored.sum() < 0.5 * 50 * 400


def test_few_users_sent_on_draw_one_copy_of_a_block(spark, monkeypatch):
    """Five of 200 users look the other way and meet every block.  They are grouped
    anew, so each further block is copied once, not for each of ten user blocks."""
    rng = np.random.default_rng(5)
    h = np.stack([3.0 - np.arange(300) * 0.008, rng.uniform(0, 0.05, 300)], axis=1)
    w = np.tile([1.0, 0.01], (200, 1)) * rng.uniform(1, 1.2, (200, 1))
    odd = [17, 50, 101, 133, 180]
    w[odd] = [0.01, 1.0]
    as_table = lambda x: spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "key bigint, f0 double, f1 double")
    model = FA.FactorModel("als", 2, as_table(w), as_table(h))
    seen = spark.range(200).select(F.col("id").alias("client_id"), (F.col("id") % 20).alias("merchant_id"))
    items = spark.range(300).select(F.col("id").alias("merchant_id"))
    written, real = [], FA.reliable

    def spy(df):
        out = real(df)
        if "_to" in out.columns:
            written.append(sorted((r["client_id"], len(r["_to"])) for r in out.collect()))
        return out

    met = spark.sparkContext.accumulator(0)
    cell = FA._factor_cell

    def counted(a, b, *rest):
        met.add(len(b))
        return cell(a, b, *rest)

    monkeypatch.setattr(FA, "reliable", spy)
    monkeypatch.setattr(FA, "_factor_cell", counted)
    top = FA.recommend_factors(model, seen, items, n=5, user_block=20, item_block=50, step=10)
    got = {}
    for r in top.orderBy("client_id", "rank").collect():
        got.setdefault(r["client_id"], []).append(r["merchant_id"])
    score = np.round(w @ h.T, 9)
    score[np.arange(200), np.arange(200) % 20] = -np.inf
    assert got == {u: np.lexsort((np.arange(300), -score[u]))[:5].tolist() for u in range(200)}
    assert met.value <= 10 * 60 + 300  # ten copies of the first block, one of the others
    assert written == [[(u, 5) for u in odd]]


@pytest.mark.parametrize("clip_range", [None, (1.0, 5.0)])
def test_lists_of_a_cell_are_merged_for_all_users_at_once(clip_range):
    """Ties, users that own much of a block, floors and undefined factors; no frame for each user."""
    rng = np.random.default_rng(2)
    f, h = rng.integers(0, 3, (700, 4)).astype(float), rng.integers(0, 3, (90, 4)).astype(float)
    f[5, 0] = np.nan
    ids = rng.permutation(300)[:90]
    own = [rng.choice(ids, rng.integers(0, 90), replace=False) for _ in range(700)]
    floor = rng.choice([-np.inf, 3.0], 700)
    a = pd.DataFrame({"u": np.arange(700), "_f": list(f), "_norm": np.linalg.norm(f, axis=1), "_floor": floor, "_own": own})
    b = pd.DataFrame({"i": ids, "_f": list(h), "_norm": np.linalg.norm(h, axis=1)})
    frames, concat = [], pd.concat
    with pytest.MonkeyPatch.context() as m:
        m.setattr(FA.pd, "concat", lambda parts: frames.append(len(parts)) or concat(parts))
        out = FA._factor_cell(a, b, "u", "i", 6, clip_range, 16, False)
    assert frames == [-(-700 // FA.BATCH)]
    got = {u: list(zip(g["i"], g["score"])) for u, g in out.groupby("u")}
    for u in range(700):
        s = f[u] @ h.T
        s = np.clip(s, *clip_range) if clip_range else s
        s = np.where(np.isin(ids, own[u]) | ~(s >= floor[u]), -np.inf, s)
        order = [k for k in np.lexsort((ids, -s))[:6] if s[k] > -np.inf]
        assert got.get(u, []) == [(ids[k], s[k]) for k in order]


def test_predictions_and_factor_items(svd, ratings, dense):
    p = FA.predict(svd, ratings.limit(50)).collect()
    full = table(svd.users, 5, 200) @ table(svd.items, 5, 200).T
    for r in p:
        raw = full[r["client_id"], r["merchant_id"]]
        assert abs(r["raw_prediction"] - raw) < 1e-9 and abs(r["prediction"] - np.clip(raw, 1, 5)) < 1e-9
    v = table(svd.items, 5, 200)
    for r in FA.factor_top_items(svd, 2, 3).collect():
        assert r["merchant_id"] == np.lexsort((np.arange(200), -v[:, r["factor"]]))[r["rank"] - 1]


def test_all_models_share_the_holdout(spark, micro_tx):
    from tillrec.operators import interactions as IN
    from tillrec.plans import base
    from tillrec.plans import evaluation as EVP

    cf = EVP.cf_run(base.visits(micro_tx), min_items=2)
    mf = EVP.mf_run(IN.ratings(micro_tx), k=2, min_items=2)
    rows = lambda df: sorted((r["client_id"], r["merchant_id"]) for r in df.collect())
    assert rows(cf.relevant) == rows(mf.eval.relevant) and rows(cf.relevant)
    assert sorted(map(tuple, cf.users.collect())) == sorted(map(tuple, mf.eval.users.collect()))
    errors = {r["model"]: r["rmse"] for r in EVP.mf_errors(mf).collect()}
    p = mf.test_pred.toPandas()
    for name, g in p.groupby("model"):
        assert abs(errors[name] - np.sqrt(((g.rating - g.prediction) ** 2).mean())) < 1e-12


def test_null_amounts_count_as_visits(spark):
    from tillrec.operators import neighbors as NB
    from tillrec.plans import base

    rows = [(1, 10, None), (1, 11, 5.0), (2, 10, None), (2, 11, 1.0), (2, 12, None)]
    tx = spark.createDataFrame(rows, "client_id bigint, merchant_id bigint, amount double")
    got = [(r["client_id"], r["merchant_id"], r["score"]) for r in NB.recommend_user_based(base.visits(tx)).collect()]
    assert got == [(1, 12, 1.0)]


def test_money_sum_keeps_small_amounts(spark):
    from tillrec.functions.scalar import money_sum

    assert spark.range(1000).select(F.lit(0.004).alias("a")).agg(money_sum("a").alias("s")).first()["s"] == 4.0


def test_ranks_of_any_id_type(spark):
    from tillrec.operators.interactions import index_ids

    rng = np.random.default_rng(1)
    for ids in ([int(x) for x in rng.integers(-(2**62), 2**62, 3000)], [f"k{x}" for x in range(2000)]):
        kind = "bigint" if isinstance(ids[0], int) else "string"
        got = {r["a"]: r["a_idx"] for r in index_ids(spark.createDataFrame([(x,) for x in ids], f"a {kind}"), "a").collect()}
        assert got == {x: k for k, x in enumerate(sorted(set(ids)))}


def test_salted_join_splits_a_hot_key(spark):
    from tillrec.operators.common import salted_join

    left = spark.range(5000).select(F.col("id").alias("l"), F.when(F.col("id") < 4000, 1).otherwise(F.col("id") % 7).alias("k"))
    right = spark.range(7).select(F.col("id").alias("k"), (F.col("id") * 10).alias("r"))
    want = sorted(map(tuple, left.join(right, "k").select("l", "k", "r").collect()))
    out = salted_join(left, right, "k", limit=500)
    assert sorted(map(tuple, out.select("l", "k", "r").collect())) == want
    assert "number of parts" not in out.columns and "_salt" not in out.columns


def test_ellipsis_cuts_long_labels(spark):
    from tillrec.functions.scalar import ellipsize

    got = spark.createDataFrame([("a" * 30,), ("short",)], "x string").select(ellipsize("x", 20).alias("y")).collect()
    assert len(got[0]["y"]) <= 23 and got[0]["y"].endswith("...") and got[1]["y"] == "short"


def test_plan_does_not_grow_with_the_square_of_the_blocks(spark):
    """Sixty blocks of items were sixty branches, each with all edges, wherever a plan had an item."""
    cols = [F.rand(j).alias(c) for j, c in enumerate(FA.fcols("f", 3))]
    model = FA.FactorModel("svd", 3, spark.range(4).select(F.col("id").alias("key"), *cols), spark.range(120).select(F.col("id").alias("key"), *cols))
    visits = spark.range(4).select(F.col("id").alias("client_id"), F.col("id").alias("merchant_id"))
    items = spark.range(120).select(F.col("id").alias("merchant_id"))
    size = lambda block: len(FA.recommend_factors(model, visits, items, n=2, item_block=block)._jdf.queryExecution().analyzed().toString())
    assert size(2) < 5 * size(20)


def test_blocks_of_a_grid_share_no_partition(spark, ratings, monkeypatch):
    """Products summed where X lay by one key sent a row for each user and partition; in a grid, one for each group of the other key."""
    monkeypatch.setattr(FA, "BROADCAST_FACTOR_BYTES", 0)
    monkeypatch.setattr(FA, "GRID_RATINGS", 200)
    mx = FA._Matrix(ratings, "client_id", "merchant_id", "rating")
    assert mx.groups and mx.parts == mx.groups["u"] * mx.groups["i"] >= 9
    rows = ratings.select("client_id", "merchant_id", "rating").collect()
    for key, out in (("u", "i"), ("i", "u")):
        placed = mx.by[key].withColumn("p", F.spark_partition_id())
        assert placed.groupBy("p").agg(F.countDistinct(FA.BLOCK).alias("n")).agg(F.max("n")).first()[0] == 1
        assert placed.groupBy(out).agg(F.countDistinct("p").alias("n")).agg(F.max("n")).first()[0] <= mx.groups[key]
        fac = mx.keys(key).select("key", (F.col("key") % 7 + 1).cast("double").alias("f0"))
        want = {}
        for u, i, x in rows:
            k, o = (u, i) if key == "u" else (i, u)
            want[o] = want.get(o, 0.0) + x * (k % 7 + 1)
        product = mx.product(key, out, fac, ["f0"], ["f0"])
        got = {r["key"]: r["f0"] for r in product.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
        above = mx.product(key, out, fac, ["f0"], ["f0"])._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
        assert above.count("Exchange") == 1  # the sums; X stays where it is
    monkeypatch.setattr(FA, "STEP_RATINGS", 3)
    x = pa.table({"u": [1, 2, 1, 3, 1, 9], "i": ["a", "b", "b", "c", "d", "z"], "x": [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]})
    f = pa.table({"i": ["d", "c", "b", "a"], "f0": [4.0, 3.0, 2.0, 1.0], "f1": [1.0, 1.0, 1.0, 0.0]})
    assert FA._block_product(x, f, "i", "u", ["f0", "f1"]).to_pydict() == {"key": [1, 2, 3], "f0": [27.0, 4.0, 12.0], "f1": [8.0, 2.0, 4.0]}
    assert FA._block_product(x, f.slice(0, 0), "i", "u", ["f0", "f1"]).num_rows == 0
    mx.release()


def test_written_factors_keep_no_second_copy(spark, ratings):
    """A factor table was persisted and written, and the files of its shuffles stayed."""
    mx = FA._Matrix(ratings, "client_id", "merchant_id", "rating")
    fac = mx.keys("i").select("key", F.lit(1.0).alias("f0"))
    kept = mx.keep(mx.product("i", "u", fac, ["f0"], ["f0"]))
    mx.release()
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" in plan and "InMemoryRelation" not in plan
    assert kept.count()
