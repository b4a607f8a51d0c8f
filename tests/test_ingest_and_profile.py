"""Reject table, profile counted while writing, quantiles by selection, time splits, bucketed pairs."""

import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillrec.operators import common as C
from tillrec.operators import interactions as IN
from tillrec.operators import similarity as SI


def fresh():
    return tempfile.mkdtemp(prefix="tillrec-test-")


GOOD = [
    "1,2010-01-01 00:01:00,10,$10.00,100,Austin,TX,5411",
    '2,2010-01-01 09:30:00,10,"$1,234.56",101,"Dallas, north",TX,5812',
    "3,2010-01-02 12:00:00,,$-77.00,100,,,",
]
BAD = {
    "4,2010-13-45 00:00:00,10,$1.00,100,A,TX,1": ["date: not a date"],
    "5,2010-01-01 00:00:00,10,ten,100,A,TX,1": ["amount: not an amount"],
    "6,2010-01-01 00:00:00,10,$1.00": ["wrong number of fields"],
    "7,2010-01-01 00:00:00,10,$1.00,100,A,TX,1,extra": ["wrong number of fields"],
    "x,yesterday,1.5,$1.00,100,A,TX,1": ["id: not bigint", "date: not a date", "client_id: not bigint"],
    ",2010-01-01 00:00:00,10,$1.00,100,A,TX,1": ["id: missing"],
}


def test_rejects_and_clean_add_up(spark):
    from tillrec.plans.jobs import ingest

    d = fresh()
    with open(f"{d}/a.csv", "w") as f:
        f.write("id,date,client_id,amount,merchant_id,merchant_city,merchant_state,mcc\n" + "\n".join([*GOOD, *BAD]) + "\n")
    counts = ingest(spark, f"{d}/a.csv", f"{d}/out")
    assert counts == {"clean": len(GOOD), "rejected": len(BAD)}
    clean = {r["id"]: r for r in spark.read.parquet(f"{d}/out/transactions").collect()}
    assert sorted(clean) == [1, 2, 3] and clean[2]["amount"] == 1234.56 and clean[2]["merchant_city"] == "Dallas, north"
    assert clean[3]["client_id"] is None and clean[3]["mcc"] is None and clean[1]["hour"] == 0
    rejects = {r["record"]: r["reasons"] for r in spark.read.parquet(f"{d}/out/rejected_transactions").collect()}
    assert rejects == BAD


def test_rejects_of_users_and_cards(spark):
    from tillrec.sources import rejects as RJ

    d = fresh()
    with open(f"{d}/u.csv", "w") as f:  # another column order, a column of its own
        f.write("credit_score,id,yearly_income,note\n700,1,$50000,a\nbad,2,$1,b\n650,3,plenty,c\n")
    u = RJ.read_checked(spark, f"{d}/u.csv", RJ.USERS)
    assert [(r["id"], r["credit_score"], r["current_age"]) for r in RJ.accepted(u).collect()] == [(1, 700, None)]
    assert {r["record"]: r["reasons"] for r in RJ.rejected(u).collect()} == {
        "bad,2,$1,b": ["credit_score: not int"], "650,3,plenty,c": ["yearly_income: not an amount"]}
    with open(f"{d}/c.csv", "w") as f:
        f.write("id,client_id,card_type,credit_limit\n")
    c = RJ.read_checked(spark, f"{d}/c.csv", RJ.CARDS)
    assert RJ.accepted(c).count() == 0 and RJ.rejected(c).count() == 0


def test_demographics_and_income_pairs_from_files(spark):
    """D15 (age), D19 and D25 with the columns that the driver tables lack."""
    from tillrec.functions.scalar import parse_money
    from tillrec.operators import analytics as AN
    from tillrec.sources.readers import read_cards, read_users

    d, rnd = fresh(), random.Random(5)
    people = [(i, rnd.randint(18, 90), rnd.randint(10_000, 90_000), rnd.randint(450, 850)) for i in range(200)]
    with open(f"{d}/u.csv", "w") as f:
        f.write("id,current_age,yearly_income,total_debt,credit_score\n")
        f.writelines(f'{i},{a},"${w:,}",$0,{s}\n' for i, a, w, s in people)
    with open(f"{d}/c.csv", "w") as f:
        f.write("id,client_id,card_type,credit_limit\n")
        f.writelines(f"{k},{k // 2},Debit,${k * 10}\n" for k in range(400))
    users, cards = read_users(spark, f"{d}/u.csv"), read_cards(spark, f"{d}/c.csv")
    got = {r["metric"]: r["value"] for r in AN.demographics(users, cards).collect()}
    age, income, score = (np.array([p[k] for p in people], float) for k in (1, 2, 3))
    exp = {"avg_age": age.mean(), "avg_income": income.mean(), "avg_credit_score": score.mean(), "n_cards": 400, "avg_credit_limit": 1995.0}
    assert got.keys() == exp.keys() and all(abs(got[k] - exp[k]) < 1e-5 for k in exp)
    both = users.select(parse_money("yearly_income").alias("income"), F.col("credit_score").cast("double").alias("score"))
    c = AN.pair_correlation(both, "income", "score").first()
    assert c["n"] == 200 and abs(c["corr"] - np.corrcoef(income, score)[0, 1]) < 1e-6
    cells = {(r["x_bin"], r["y_bin"]): r["n"] for r in AN.binned_pairs(both, "income", "score", 20_000, 100).collect()}
    exp_cells: dict = {}
    for w, s in zip(income, score):
        key = (int(w // 20_000), int(s // 100))
        exp_cells[key] = exp_cells.get(key, 0) + 1
    assert cells == exp_cells
    for col, values, bins in (("current_age", age, 30), ("credit_score", score, 30)):
        counts, edges = np.histogram(values, bins)
        rows = AN.histogram(spark, users, col, bins).orderBy("bin").collect()
        assert [r["n"] for r in rows] == counts.tolist() and abs(rows[0]["bin_lo"] - edges[0]) < 1e-6


def test_write_profiles_in_the_same_job(spark, micro_tx):
    from tillrec.operators.profile import null_counts
    from tillrec.sources.sinks import write_transactions

    d = fresh()
    prof = {r["column_name"]: r for r in write_transactions(micro_tx, f"{d}/tx").collect()}
    exp = {r["column_name"]: r["n_null"] for r in null_counts(micro_tx).collect()}
    assert {c: r["n_null"] for c, r in prof.items()} == exp
    assert all(r["n_rows"] == 11 for r in prof.values()) and prof["amount"]["data_type"] == "double"
    assert spark.read.parquet(f"{d}/tx").count() == 11


@pytest.mark.parametrize("bins", [2, 3, 1024])
def test_quantiles_by_selection(spark, bins):
    rng = np.random.default_rng(3)
    cols = {
        "a": rng.standard_normal(501) * 1e3,
        "b": np.repeat([1.0, 1.0, 2.0], 167),  # ties
        "c": 10.0 ** rng.uniform(-300, 300, 501) * rng.choice([-1, 1], 501),
        "d": np.where(rng.random(501) < 0.3, np.nan, rng.integers(0, 5, 501)),
        "e": np.full(501, np.nan),
        "f": np.append(rng.integers(-(2**52), 2**52, 499).astype(float), [1.7e308, -1.7e308]),
    }
    rows = [tuple(None if np.isnan(v) and k % 2 else float(v) for v in r) for k, r in enumerate(zip(*cols.values()))]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols))
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    if bins < 100:
        df, cols = df.select("a", "b", "d"), {c: cols[c] for c in "abd"}
    got = {(r["column_name"], r["prob"]): r["value"] for r in C.exact_quantiles(df, probs, bins).collect()}
    for c, v in cols.items():
        v = np.sort(v[~np.isnan(v)])
        for p in probs:
            if not len(v):
                assert (c, p) not in got
                continue
            at = (len(v) - 1) * p
            lo, hi = v[int(at)], v[int(np.ceil(at))]
            assert got[c, p] == lo + (hi - lo) * (at - int(at)), (c, p)


def test_describe_shuffles_no_values(spark, micro_tx):
    from tillrec.operators.profile import describe_numeric

    out = describe_numeric(micro_tx, ["amount", "mcc"])
    assert "rangepartitioning" not in out._jdf.queryExecution().toString().lower()
    r = {x["column_name"]: x for x in out.collect()}["amount"]
    v = np.array([10.0, 1234.56, 20, -77, 50, 0, 500, 100.01, 5.5, 30, 12])
    assert r["count"] == 11 and abs(r["q50"] - np.median(v)) < 1e-4 and abs(r["q25"] - np.quantile(v, 0.25)) < 1e-4


def test_no_training_row_is_later_than_a_test_row(spark, micro_tx):
    s = IN.split_by_time(micro_tx, 0.3)
    got = [(r["date"], r["is_test"]) for r in s.collect()]
    late = [d for d, t in got if t]
    assert len(got) == 11 and 0 < len(late) <= 0.3 * 11 + 1
    assert max(d for d, t in got if not t) < min(late)
    assert IN.split_by_time(micro_tx.where("false")).count() == 0
    same = micro_tx.withColumn("date", F.lit("2020-01-01").cast("timestamp"))
    assert IN.split_by_time(same).where("is_test").count() == 0
    some = micro_tx.withColumn("date", F.when(F.col("id") > 3, F.col("date")))
    assert IN.split_by_time(some, 0.3).where("is_test and date is null").count() == 0


def test_last_row_of_each_user_tests(spark, micro_tx):
    got = {r["id"] for r in IN.leave_last(micro_tx).where("is_test").collect()}
    rows = micro_tx.select("client_id", "date", "id").collect()
    exp = {max((r["date"], r["id"]) for r in rows if r["client_id"] == u)[1] for u in {r["client_id"] for r in rows}}
    assert got == exp


def test_bucketed_pairs_need_no_exchange(spark):
    from tillrec.sources.sinks import write_cells

    rnd = random.Random(2)
    cells = {(u, i): rnd.randint(1, 3) for u in range(80) for i in rnd.sample(range(40), 4)} | {(u, 99): 1 for u in range(80)}
    ix = spark.createDataFrame([(u, i, c) for (u, i), c in cells.items()], "client_id bigint, merchant_id bigint, transaction_count bigint")
    name = f"cells_{random.randrange(1 << 40):x}"
    warehouse = fresh()
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{warehouse}/{name}'")
    try:
        write_cells(ix, f"{name}.by_item", "client_id", "merchant_id", buckets=4)
        t = spark.table(f"{name}.by_item")
        exp = {(r[0], r[1]): r[2] for r in SI.user_similarity(ix).collect()}
        for heavy in (2000, 20):
            got = {(r[0], r[1]): r[2] for r in SI.bucketed_cosine_pairs(t, heavy).where("sim > 0").collect()}
            assert got.keys() == exp.keys() and all(abs(got[k] - exp[k]) < 1e-12 for k in exp)
        old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # a small table would be broadcast
        try:
            light = SI._meet(t.where("_m <= 2000").drop("_m"), ["_k", "_v", "_n"], None)
            plan = light._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.sql(f"DROP DATABASE {name} CASCADE")


def test_time_split_reads_its_rows_once(spark, micro_tx):
    """What makes the rows (here a join) runs once, not in every scan of the selection and again for the result."""
    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            calls.add(len(b))
            yield b

    rows = micro_tx.select("id", "date").mapInPandas(seen, "id bigint, date timestamp")
    got = IN.split_by_time(rows, 0.3).collect()
    assert calls.value == len(got) == micro_tx.count()
