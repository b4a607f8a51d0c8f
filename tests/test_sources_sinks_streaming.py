"""Readers (A1-A7, A13), sinks (A8-A12) and the incremental interaction job."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import MICRO_CODES, MICRO_LABELS, MICRO_TX


def _fresh():
    return tempfile.mkdtemp(prefix="tillrec-test-")


def _write_csv(path, header, rows):
    with open(path, "w") as f:
        f.write(",".join(header) + "\n")
        for r in rows:
            f.write(",".join("" if v is None else (f'"{v}"' if isinstance(v, str) else str(v)) for v in r) + "\n")


def test_read_transactions_csv_by_name(spark):
    d = _fresh()
    # column order differs from the canonical one and an extra column exists
    header = ["merchant_id", "id", "date", "client_id", "card_id", "amount", "merchant_city", "merchant_state", "mcc"]
    rows = [(t[4], t[0], t[1], t[2], 7, t[3], t[5], t[6], t[7]) for t in MICRO_TX]
    _write_csv(f"{d}/tx.csv", header, rows)
    from tillrec.operators.clean import clean_transactions
    from tillrec.sources.readers import read_transactions

    tx = clean_transactions(read_transactions(spark, f"{d}/tx.csv"))
    got = {r.id: r.amount for r in tx.collect()}
    assert got[2] == 1234.56 and got[4] == -77.0 and len(got) == 11


def test_code_map_and_labels(spark):
    d = _fresh()
    with open(f"{d}/codes.json", "w") as f:
        json.dump(MICRO_CODES, f, indent=2)
    with open(f"{d}/labels.json", "w") as f:
        json.dump({"target": MICRO_LABELS}, f)
    from tillrec.sources.readers import read_code_map, read_labels

    codes = {r.mcc: r.mcc_description for r in read_code_map(spark, f"{d}/codes.json").collect()}
    assert codes == MICRO_CODES
    assert sorted(tuple(r) for r in read_labels(spark, f"{d}/labels.json").collect()) == sorted(MICRO_LABELS.items())


def test_read_all_union_by_name(spark):
    d = _fresh()
    _write_csv(f"{d}/a.csv", ["id", "x"], [(1, "p")])
    _write_csv(f"{d}/b.csv", ["y", "id"], [("q", 2)])
    from tillrec.sources.readers import read_all

    df = read_all(spark, f"{d}/*.csv")
    assert sorted(df.columns) == ["id", "x", "y"] and df.count() == 2
    _write_csv(f"{d}/c.csv", ["id", "x"], [(3, "r")])
    assert sorted((r.id, r.x, r.y) for r in read_all(spark, f"{d}/*.csv").collect()) == [("1", "p", None), ("2", None, "q"), ("3", "r", None)]


def test_users_and_cards_csv(spark):
    from tillrec.sources.readers import read_cards, read_users
    from tillrec.sources.schemas import CARD_COLUMNS, USER_COLUMNS

    d = _fresh()
    for read, columns in ((read_users, USER_COLUMNS), (read_cards, CARD_COLUMNS)):
        names = list(columns)
        _write_csv(f"{d}/{read.__name__}.csv", names[::-1], [["1"] * len(names)])
        df = read(spark, f"{d}/{read.__name__}.csv")
        assert df.columns == names and df.count() == 1


def test_profile_and_samples(spark, micro_tx):
    from tillrec.operators import profile as PR

    schema = {r.column_name: r.data_type for r in PR.profile_schema(spark, micro_tx).collect()}
    assert list(schema) == micro_tx.columns and schema["amount"] == "double"
    num, cat = PR.column_kinds(micro_tx)
    assert "amount" in num and "merchant_city" in cat
    a, b = (sorted(r.id for r in PR.sample_rows(micro_tx.repartition(k), 4).collect()) for k in (1, 3))
    assert a == b and len(a) == 4


def test_interactions_sink(spark, micro_ix):
    from tillrec.sources import sinks

    d = _fresh()
    sinks.write_interactions(micro_ix, f"{d}/p")
    sinks.write_interactions(micro_ix, f"{d}/c", fmt="csv")
    assert spark.read.parquet(f"{d}/p").count() == spark.read.option("header", True).csv(f"{d}/c").count() == micro_ix.count()


def test_head_sample_is_opt_in(micro_tx):
    from tillrec.sources.readers import head_sample

    assert head_sample(micro_tx, None).count() == 11
    assert [r.id for r in head_sample(micro_tx, 3, ["id"]).collect()] == [1, 2, 3]


def test_sinks_round_trip(spark, micro_tx, micro_ix):
    d = _fresh()
    from tillrec.operators.evaluate import best_by_metric
    from tillrec.sources import sinks
    from tillrec.sources.readers import read_evaluation_results

    sinks.write_transactions(micro_tx, f"{d}/tx")
    assert spark.read.parquet(f"{d}/tx").where("year = 2010").count() == 11
    sinks.write_matrix(micro_ix, f"{d}/wide", "client_id", "merchant_id", "transaction_count",
                       values=[100, 101, 102, 103, 104], fmt="csv")
    wide = spark.read.option("header", True).csv(f"{d}/wide")
    assert wide.count() == 4 and len(wide.columns) == 6
    with pytest.raises(ValueError):
        sinks.write_matrix(micro_ix, f"{d}/w2", "client_id", "merchant_id", "transaction_count", fmt="csv")
    metrics = spark.createDataFrame(
        [("svd", "rmse", None, 0.5), ("svd", "precision", 5, 0.1), ("svd", "precision", 10, 0.05),
         ("cf", "precision", 5, 0.2), ("cf", "coverage", None, 0.01)],
        "model string, metric string, k int, value double",
    )
    sinks.write_evaluation_results(metrics, f"{d}/eval", {"cf": "Collaborative Filtering", "svd": "SVD"})
    files = [f for f in os.listdir(f"{d}/eval") if f.endswith(".json")]
    objs = [json.loads(line) for f in files for line in open(f"{d}/eval/{f}")]
    svd = next(o for o in objs if o["model"] == "svd")
    assert svd["precision_at_k"] == {"5": 0.1, "10": 0.05} and svd["rmse"] == 0.5
    back = read_evaluation_results(spark, f"{d}/eval")
    assert sorted((r.model, r.metric, r.k or 0, r.value) for r in back.collect()) == sorted((r.model, r.metric, r.k or 0, r.value) for r in metrics.collect())
    # Read it back as one JSON document keyed by model
    doc = {o["model"]: {k: v for k, v in o.items() if k != "model"} for o in objs}
    with open(f"{d}/results.json", "w") as f:
        json.dump(doc, f)
    back = read_evaluation_results(spark, f"{d}/results.json")
    assert back.where("model = 'svd' AND metric = 'precision' AND k = 10").first().value == 0.05
    sinks.write_model_comparison(metrics, f"{d}/cmp")
    cmp = spark.read.option("header", True).csv(f"{d}/cmp")
    row = cmp.where("model = 'cf'").first()
    assert row.rmse == "N/A" and row.precision_5 == "0.2000"
    assert {r.metric for r in best_by_metric(metrics).collect()} == {"rmse", "precision", "coverage"}


def test_incremental_interactions_match_batch(spark, micro_raw, micro_ix):
    from tillrec.streaming.interactions import latest_interactions, start_interactions

    src, table, ck = _fresh(), _fresh() + "/t", _fresh() + "/ck"
    micro_raw.where("id <= 5").coalesce(1).write.mode("overwrite").parquet(f"{src}/part1")
    q = start_interactions(spark, f"{src}/part1", table, ck, available_now=True)
    q.awaitTermination(120)
    first = {(r.client_id, r.merchant_id): r.transaction_count for r in latest_interactions(spark, table).collect()}
    assert first[(10, 100)] == 2 and (40, 103) not in first
    # second arrival: the remaining rows, same source folder
    micro_raw.where("id > 5").coalesce(1).write.mode("append").parquet(f"{src}/part1")
    q = start_interactions(spark, f"{src}/part1", table, ck, available_now=True)
    q.awaitTermination(120)
    got = sorted((r.client_id, r.merchant_id, r.transaction_count, round(r.total_amount, 2))
                 for r in latest_interactions(spark, table).collect())
    exp = sorted((r.client_id, r.merchant_id, r.transaction_count, round(r.total_amount, 2)) for r in micro_ix.collect())
    assert got == exp


def test_log_is_compacted(spark, micro_raw, micro_ix):
    """Bases every two batches: the result is the same and older batches are not read."""
    from tillrec.streaming.interactions import _finished_base, compact, latest_interactions, start_interactions

    src, table, ck = _fresh(), _fresh() + "/t", _fresh() + "/ck"
    for k in range(5):
        micro_raw.where(F.col("id") % 5 == k).coalesce(1).write.mode("append").parquet(f"{src}/in")
        q = start_interactions(spark, f"{src}/in", table, ck, available_now=True, compact_every=2)
        q.awaitTermination(120)
    assert _finished_base(spark, table) == 3
    exp = sorted((r.client_id, r.merchant_id, r.transaction_count, round(r.total_amount, 2)) for r in micro_ix.collect())
    rows = lambda: sorted((r.client_id, r.merchant_id, r.transaction_count, round(r.total_amount, 2)) for r in latest_interactions(spark, table).collect())
    assert rows() == exp
    plan = latest_interactions(spark, table)._jdf.queryExecution().executedPlan().toString()
    assert any("batch_id" in part[:200] for part in plan.split("PartitionFilters")[1:])
    compact(spark, table, 4)
    compact(spark, table, 4)  # a batch that runs again
    assert _finished_base(spark, table) == 4 and rows() == exp
