"""Nearest neighbours by cells, threshold pairs, requested pairs, sampled pairs and list diversity."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillrec.operators import neighbors as NB
from tillrec.operators import similarity as SI
from tillrec.operators.evaluate import list_diversity


def table(spark, n_users=60, n_items=25, hot=True, seed=3, text=False):
    rnd = random.Random(seed)
    rows = {(u, rnd.randrange(n_items)): rnd.randint(1, 4) for u in range(n_users) for _ in range(rnd.randint(1, 7))}
    if hot:  # an item that nearly all use, and two users with equal vectors
        rows |= {(u, n_items): 1 for u in range(n_users - 5)}
        rows |= {(n_users, i): 2 for i in (1, 2, 3)} | {(n_users + 1, i): 2 for i in (1, 2, 3)}
    name = (lambda v: f"k{v:03d}") if text else (lambda v: v)
    kind = "string" if text else "bigint"
    return spark.createDataFrame([(name(u), name(i), c) for (u, i), c in rows.items()], f"client_id {kind}, merchant_id {kind}, transaction_count bigint")


def brute(ix, key="client_id", other="merchant_id"):
    vec = {}
    for r in ix.collect():
        vec.setdefault(r[key], {})[r[other]] = float(r["transaction_count"])
    norm = {k: math.sqrt(sum(x * x for x in v.values())) for k, v in vec.items()}
    sims = {}
    for a, b in itertools.combinations(sorted(vec), 2):
        dot = sum(x * vec[b].get(i, 0.0) for i, x in vec[a].items())
        if dot:
            sims[a, b] = dot / (norm[a] * norm[b])
    return sims


def best(sims, n):
    out = {}
    for (a, b), s in sims.items():
        out.setdefault(a, []).append((-round(s, 9), b))
        out.setdefault(b, []).append((-round(s, 9), a))
    return {k: [b for _, b in sorted(v)[:n]] for k, v in out.items()}


def lists(df):
    out = {}
    for r in df.orderBy("id", "rank").collect():
        out.setdefault(r["id"], []).append(r["neighbor"])
    return out


@pytest.mark.parametrize("block_cells,products,text", [(250_000, 2_000_000, False), (40, 7, True), (5, 50, False)])
def test_nearest_neighbors_equal_brute_force(spark, monkeypatch, block_cells, products, text):
    """Small blocks make heavy keys (joined), small steps split a key's products."""
    monkeypatch.setattr(SI, "PRODUCTS", products)
    ix = table(spark, text=text)
    for key, other in (("client_id", "merchant_id"), ("merchant_id", "client_id")):
        got = lists(SI.nearest_neighbors(ix, key, other, n=4, block_cells=block_cells))
        assert got == best(brute(ix, key, other), 4)


def test_nearest_neighbors_of_wanted_keys(spark):
    ix = table(spark)
    wanted = spark.createDataFrame([(3,), (61,), (999,)], "client_id bigint")
    for cells in (250_000, 5):
        got = lists(SI.nearest_neighbors(ix, n=5, wanted=wanted, block_cells=cells))
        exp = best(brute(ix), 5)
        assert got == {k: exp[k] for k in (3, 61)}


def test_nearest_neighbors_of_nothing(spark):
    assert SI.nearest_neighbors(table(spark).where("false")).count() == 0


def test_nearest_builds_no_pair_table(spark):
    plan = SI.nearest_neighbors(table(spark))._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" in plan and "_dot" not in plan


@pytest.mark.parametrize("t", [0.05, 0.3, 0.6, 0.95])
def test_pairs_above_a_threshold(spark, t):
    ix = table(spark)
    for fn, key, other in ((SI.user_similarity, "client_id", "merchant_id"), (SI.item_similarity, "merchant_id", "client_id")):
        got = {(r[0], r[1]): r[2] for r in fn(ix, min_sim=t).collect()}
        exp = {k: s for k, s in brute(ix, key, other).items() if s > t}
        assert got.keys() == exp.keys()
        assert all(abs(got[k] - exp[k]) < 1e-12 for k in exp)


@pytest.mark.parametrize("block_cells,held,text", [(250_000, 3_000_000, False), (40, 3, True), (5, 20, False)])
def test_pairs_by_cells_equal_brute_force(spark, monkeypatch, block_cells, held, text):
    """Several blocks on both sides, heavy keys, groups cut into lists of two rows."""
    monkeypatch.setattr(SI, "HELD_CELLS", held)
    monkeypatch.setattr(SI, "PRODUCTS", 50)
    ix = table(spark, text=text)
    for key, other in (("client_id", "merchant_id"), ("merchant_id", "client_id")):
        w = SI.reliable(SI._weighted(SI._cells(ix, key, other, "transaction_count")))
        exp = brute(ix, key, other)
        for above in (None, 0.3):
            rows = [tuple(r) for r in SI._pair_sums(w, "a", "b", above, heavy_degree=2, block_cells=block_cells).collect()]
            got = {r[:2]: r[2] for r in rows}
            assert len(rows) == len(got) and got.keys() == {k for k, v in exp.items() if above is None or v > above}
            assert all(abs(v - exp[k]) < 1e-12 for k, v in got.items())


def test_pairs_are_summed_where_they_are_formed(spark):
    """No product or candidate pair is a row of a shuffle, with a threshold
    neither unless the prefixes leave few."""
    ix = table(spark, n_users=200, n_items=60)
    for t in (0.0, 0.25):
        plan = SI.user_similarity(ix, min_sim=t)._jdf.queryExecution().toString()
        assert "FlatMapGroupsInPandas" in plan and "_dot" not in plan
    w = SI.reliable(SI._weighted(SI._cells(ix, "client_id", "merchant_id", "transaction_count")))
    assert not SI._prefixes_pay(w, 0.25) and SI._prefixes_pay(w, 0.999)


def test_prefixes_prune_candidates(spark):
    ix = table(spark, n_users=200, n_items=60)
    w = SI._weighted(SI._cells(ix, "client_id", "merchant_id", "transaction_count"))
    every = SI.user_similarity(ix).count()
    assert SI.prefix_candidates(w, 0.8).count() < every / 5


def test_requested_pairs(spark):
    ix = table(spark)
    sims = brute(ix)
    asked = [(a, b) for a in range(0, 60, 7) for b in range(1, 60, 9) if a != b] + [(1, 999), (4, 4), (1, 999)]
    df = spark.createDataFrame(asked, "a bigint, b bigint")
    for chunk in (100_000, 2):
        got = {(r["a"], r["b"]): r["sim"] for r in SI.pair_similarity(df, ix, "a", "b", "client_id", "merchant_id", chunk_rows=chunk).collect()}
        assert got.keys() == set(asked)
        for (a, b), s in got.items():
            exp = 1.0 if a == b else sims.get((min(a, b), max(a, b)), 0.0)
            assert abs(s - exp) < 1e-12, (a, b)


def test_sampled_pairs_keep_their_error_bound(spark):
    rng = np.random.default_rng(5)
    users = 4000
    shared = rng.random(users) < 0.5
    cols = [np.where(shared, rng.random(users) < 0.8, rng.random(users) < 0.2) for _ in range(6)]
    rows = [(u, i, 1) for i, c in enumerate(cols) for u in np.flatnonzero(c).tolist()]
    ix = spark.createDataFrame(rows, "client_id bigint, merchant_id bigint, transaction_count bigint")
    exact = {(r[0], r[1]): r[2] for r in SI.item_similarity(ix).collect()}
    est = {(r[0], r[1]): r[2] for r in SI.approximate_item_pairs(ix, 0.5, oversample=100.0).collect()}
    kept = [k for k, s in exact.items() if s >= 0.5]
    assert len(kept) == 15
    assert all(abs(est[k] - exact[k]) / exact[k] < 0.25 for k in kept)
    small = table(spark)  # norms below the bound: nothing is thinned
    a = {(r[0], r[1]): r[2] for r in SI.item_similarity(small).collect()}
    b = {(r[0], r[1]): r[2] for r in SI.approximate_item_pairs(small, 0.01).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_list_diversity_equals_brute_force(spark):
    ix = table(spark)
    sims = brute(ix, "merchant_id", "client_id")
    rnd = random.Random(9)
    recs, exp = [], {}
    for model in ("a", "b"):
        means = []
        for u in range(30):
            items = rnd.sample(range(40), 1 if u == 0 else rnd.randint(2, 12))  # some unknown to the table
            recs += [(model, u, k + 1, i, 1.0) for k, i in enumerate(items)]
            pairs = list(itertools.combinations(sorted(items[:10]), 2))
            if pairs:
                means.append(sum(1 - sims.get(p, 0.0) for p in pairs) / len(pairs))
        exp[model] = (len(means), sum(means) / len(means))
    df = spark.createDataFrame(recs, "model string, client_id bigint, rank int, merchant_id bigint, score double")
    got = {r["model"]: (r["n_users"], r["diversity"]) for r in list_diversity(df, ix, 10).collect()}
    assert got.keys() == exp.keys()
    for m in exp:
        assert got[m][0] == exp[m][0] and abs(got[m][1] - exp[m][1]) < 1e-6
    assert list_diversity(df.where("client_id = 0"), ix).count() == 0


def test_visits_travel_as_lists(spark, monkeypatch):
    """User-based lists: visits are laid out after the shuffle by user, and cutting long lists changes nothing."""
    ix = table(spark)
    whole = NB.recommend_user_based(ix, n=5)
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("Generate explode") < plan.index("RepartitionByExpression [client_id")
    exp = sorted(tuple(r) for r in whole.collect())
    monkeypatch.setattr(NB, "LIST_VISITS", 1)
    assert exp and sorted(tuple(r) for r in NB.recommend_user_based(ix, n=5).collect()) == exp


def test_item_based_sides_travel_as_lists(spark, monkeypatch):
    """Many blocks, and visits of a user in lists of one, give what one block gives; neither side is a row for each visit or pair."""
    ix = table(spark)
    exp = sorted(tuple(r) for r in NB.recommend_item_based(ix, n=5).collect())
    monkeypatch.setattr(NB, "LIST_VISITS", 1)
    cut = NB.recommend_item_based(ix, n=5, user_block=40, item_block=100)
    inputs = cut._jdf.queryExecution().analyzed().toString()
    assert "collect_list(struct(_v" in inputs and "collect_list(struct(merchant_id" in inputs
    assert exp and sorted(tuple(r) for r in cut.collect()) == exp


def test_short_lists_leave_the_cells_as_lists(spark):
    """n rows for each user and cell were shuffled; now one row for each group of users and cell, and their lists are right."""
    ix = table(spark)
    top = NB.recommend_item_based(ix, n=5, user_block=40, item_block=100)
    assert "Window" not in top._jdf.queryExecution().analyzed().toString().split("FlatMapCoGroupsInArrow")[0]
    assert {t for _, t in top.dtypes} == {"bigint", "int", "double"}


@pytest.mark.parametrize("width", [7, 50_000])
def test_best_of_sums_keeps_ties_by_item(width):
    """Dense and sorted sums, ties at the floor, left-out items, users without any."""
    rng = np.random.default_rng(width)
    user, item = rng.integers(0, 30, 400), rng.integers(0, 7, 400) * (width // 7)
    user[user == 3] = 4
    sims, counts = rng.choice([0.5, 1.0], 400), rng.choice([1.0, 2.0], 400)
    seen = np.array([2 * width, 5 * width + width // 7])
    sums = {}
    for u, i, s, c in zip(user.tolist(), item.tolist(), sims, counts):
        if u * width + i not in seen:
            num, den = sums.get((u, i), (0.0, 0.0))
            sums[u, i] = num + s * c, den + s
    want = set()
    for u in range(30):
        best = sorted((-round(num / den, 9), i) for (v, i), (num, den) in sums.items() if v == u)[:3]
        want |= {(u, i, -s) for s, i in best}
    u, i, raw = NB._best_of_sums(user * width + item, sims, counts, seen, width, 30, 3)
    assert {(a, b, c) for a, b, c in zip(u.tolist(), i.tolist(), np.round(raw, 9).tolist())} == want


def test_evaluation_writes_its_split_once(spark):
    """Every model and metric made the joins and the holdout again."""
    from tillrec.plans import evaluation as EVP

    run = EVP.cf_run(table(spark), models=("popularity",))
    for t in (run.train, run.relevant, run.users, run.n_items):
        plan = t._jdf.queryExecution().optimizedPlan().toString()
        assert "LogicalRDD" in plan and "Window" not in plan


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(k).getName().startswith("shuffle_") for k in range(files.size()))


def test_a_written_table_leaves_no_shuffle_files(spark):
    """They stayed until the driver happened to collect its garbage."""
    import time

    before = _shuffle_files(spark)
    kept = SI.reliable(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().repartition(5))
    for _ in range(50):
        if _shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert _shuffle_files(spark) <= before
    assert sorted(map(tuple, kept.collect())) == sorted((k, len(range(k, 1000, 7))) for k in range(7))


def test_rows_go_to_cells_packed(spark):
    """Every group was joined and sent as a row of lists for each pair of blocks; now rows of a key travel together."""
    ix = table(spark)
    for fn in (SI.user_similarity, SI.item_similarity, SI.nearest_neighbors):
        plan = fn(ix)._jdf.queryExecution().analyzed().toString()
        assert "MapInArrow" in plan and "collect_list" not in plan
    w = SI._narrow(SI._weighted(SI._cells(ix, "client_id", "merchant_id", "transaction_count"))).withColumn("_g", F.lit(0).cast("bigint"))
    rows = w.select("_g", "_x", "_k", "_v", "_s", "_q").coalesce(1).toArrow().to_batches()
    (lists,) = SI._packed(iter(rows), 10**6)
    assert lists.num_rows == 1 and len(lists.column("_k")[0]) == ix.select("client_id").distinct().count()
    assert len(lists.column("_x")[0]) == sum(lists.column("_len")[0].as_py()) == ix.count()
    assert str(lists.schema.field("_k").type.value_type) == "int32" and str(lists.schema.field("_v").type.value_type) == "int16"


@pytest.mark.parametrize("size", [5, 400])
def test_keep_best_takes_the_first_of_equal_ones(size):
    rng = np.random.default_rng(size)
    group = np.sort(np.append(rng.integers(0, 20, size), np.full(3 * size, 21)))
    score = rng.choice([0.1, 0.2, 0.3], len(group))
    want = np.zeros(len(group), bool)
    for g in set(group.tolist()):
        rows = np.flatnonzero(group == g)
        want[rows[np.argsort(-score[rows], kind="stable")[:3]]] = True
    assert (SI.keep_best(group, score, 3) == want).all()
    wide = np.sort(np.append(group, np.arange(22, 4000)))  # many groups, one large: no table of all by the largest
    assert SI.keep_best(wide, np.append(score, np.ones(len(wide) - len(score))), 3).sum() == want.sum() + 3978


def test_item_based_needs_no_table_of_pairs(spark):
    """Pairs were copied to every block of users; visits alone give the same lists, for some users and ids that are text too."""
    for text in (False, True):
        ix = table(spark, text=text)
        wanted = ix.select("client_id").distinct().orderBy("client_id").limit(9)
        for users in (None, wanted):
            top = NB.recommend_item_based(ix, users=users, n=4)
            plan = top._jdf.queryExecution().analyzed().toString()
            assert "CoGroups" not in plan and "FlatMapGroups" not in plan
            pairs = NB.recommend_item_based(ix, users=users, n=4, user_block=10**6, item_block=10**6)
            assert top.dtypes == pairs.dtypes
            got = sorted(tuple(r) for r in top.collect())
            assert got and got == sorted(tuple(r) for r in pairs.collect())
    few = NB.recommend_item_based(ix, n=4, held_visits=3)
    assert sorted(tuple(r) for r in few.collect()) == sorted(tuple(r) for r in NB.recommend_item_based(ix, n=4).collect())
    assert NB.recommend_item_based(ix.where("false")).count() == 0


@pytest.mark.parametrize("held,chunk", [(10**6, 10**6), (40, 50), (1, 7)])
def test_shares_of_users_add_up(monkeypatch, held, chunk):
    """Users in steps, visits sorted in ranges and one user with more products than a step, against the definition."""
    import pandas as pd

    monkeypatch.setattr(NB, "HELD_PRODUCTS", held)
    monkeypatch.setattr(NB, "CHUNK", chunk)
    rng = np.random.default_rng(4)
    c = np.where(rng.random((25, 18)) < 0.2, rng.integers(1, 4, (25, 18)), 0)
    c[24, :17] = 1  # nearly all items
    c[:, 0][c.sum(axis=1) == 0] = 1
    keys = np.arange(25) * 3
    rows = [{"_k": keys[[u]], "_s": [0.0], "_q": [u != 5], "_len": np.array([len(i)]), "_x": i[::-1] * 10, "_v": c[u, i[::-1]].astype(np.int16)}
            for u in range(25) for i in np.array_split(np.flatnonzero(c[u]), 2) if len(i)]
    sim = c.T @ c / np.sqrt(np.outer((c * c).sum(axis=0), (c * c).sum(axis=0)).clip(1))
    want = set()
    for u in range(25):
        den = sim[:, c[u] > 0].sum(axis=1)
        score = np.where((c[u] == 0) & (den > 0), np.round(sim @ c[u] / np.where(den > 0, den, 1), 9), -1)
        order = [i for i in np.lexsort((np.arange(18), -score))[:3] if score[i] >= 0]
        want |= {(3 * u, r + 1, 10 * i, score[i]) for r, i in enumerate(order) if u != 5}
    got = []
    for share in range(3):
        for u, r, i, s in NB._share_lists(SI._Side(pd.DataFrame(rows)), share, 3, 3):
            got += zip(u.tolist(), r.tolist(), i.tolist(), np.round(s, 9).tolist())
    assert len(got) == len(set(got)) and set(got) == want


def test_neighbours_are_found_once(spark):
    """They were found again to count the users of each."""
    plan = NB.recommend_user_based(table(spark))._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" not in plan
