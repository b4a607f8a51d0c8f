"""The factor queries against DuckDB on the tables of a written fit."""

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from tillrec.operators import evaluate as EV
from tillrec.operators import factors as FA
from tillrec.operators import interactions as IN
from tillrec.operators.clean import merchant_info
from tillrec.plans import base
from tillrec.plans import evaluation as EVP
from tillrec.plans import oracle as O

K = 6
MODELS = ("svd", "nmf", "als")


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("fit"))
    ratings = IN.ratings(base.tx_plain(spark, SF001))
    run = EVP.mf_run(ratings, k=K, models=MODELS)
    tables = {"train": run.eval.train, "test": run.eval.relevant, "recs": run.eval.recs, "eu": run.eval.users,
              "pred": run.test_pred, "info": merchant_info(base.tx(spark, SF001)), "ratings": ratings}
    for name, m in run.models.items():
        tables |= {f"{name}_u": m.users, f"{name}_i": m.items}
    con = duckdb.connect()
    for name, df in tables.items():
        df.write.parquet(f"{d}/{name}")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}/*.parquet'")
    dot = " + ".join(f"coalesce(u.f{j}, 0) * coalesce(i.f{j}, 0)" for j in range(K))
    con.execute("CREATE VIEW score AS " + " UNION ALL ".join(
        f"""SELECT '{m}' AS model, c.client_id, c.merchant_id, {dot} AS raw
            FROM (SELECT DISTINCT client_id FROM ratings) a CROSS JOIN (SELECT DISTINCT merchant_id FROM ratings) b
            CROSS JOIN (SELECT 1) z, LATERAL (SELECT a.client_id, b.merchant_id) c
            LEFT JOIN {m}_u u ON u.key = c.client_id LEFT JOIN {m}_i i ON i.key = c.merchant_id""" for m in MODELS))
    return run, con


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def close(got, want, tol=1e-6):
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want, key=str)):
        assert len(a) == len(b)
        for x, y in zip(a, b):
            assert abs(x - y) <= tol if isinstance(x, float) and isinstance(y, float) else x == y, (a, b)


def test_predictions(written):
    run, con = written
    want = con.execute("""SELECT s.model, t.client_id, t.merchant_id, round(greatest(1, least(5, s.raw)), 4)
                          FROM test t JOIN score s USING (client_id, merchant_id)""").fetchall()
    close(rows(run.test_pred.select("model", "client_id", "merchant_id", F.round("prediction", 4))), want, 1.1e-4)


def test_errors_and_spread(written):
    run, con = written
    want = con.execute("SELECT model, sqrt(avg((rating - prediction) ** 2)), avg(abs(rating - prediction)), count(*) FROM pred GROUP BY 1").fetchall()
    close(rows(EVP.mf_errors(run)), want, 1e-9)
    spread = run.test_pred.groupBy("model").agg(F.avg("prediction"), F.stddev_pop("prediction"))
    close(rows(spread), con.execute("SELECT model, avg(prediction), stddev_pop(prediction) FROM pred GROUP BY 1").fetchall(), 1e-9)


def test_ranked_lists(written):
    """Places are those of the full product, ties by id; scores apart by rounding only."""
    run, con = written
    want = con.execute("""SELECT model, client_id, rank, merchant_id, round(raw, 6) FROM (
        SELECT s.*, row_number() OVER (PARTITION BY model, s.client_id ORDER BY round(raw, 9) DESC, s.merchant_id) AS rank
        FROM score s JOIN eu USING (client_id)
        WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.client_id = s.client_id AND t.merchant_id = s.merchant_id)) q WHERE rank <= 20""").fetchall()
    got = rows(run.eval.recs.select("model", "client_id", "rank", "merchant_id", F.round("score", 6)))
    want = sorted(want, key=str)
    assert len(got) == len(want)
    assert sum(a[:4] != b[:4] for a, b in zip(got, want)) <= 0.001 * len(want)  # scores that are equal to 1e-9


def test_items_of_factors(written):
    run, con = written
    for m in MODELS:
        arms = " UNION ALL ".join(f"SELECT {j} AS factor, key, f{j} AS w FROM {m}_i" for j in range(5))
        want = con.execute(f"""SELECT factor, rank, key, w, merchant_city, coalesce(mcc_description, 'Unknown') FROM (
            SELECT *, row_number() OVER (PARTITION BY factor ORDER BY w DESC, key) AS rank FROM ({arms}) a) q
            LEFT JOIN info ON info.merchant_id = q.key WHERE rank <= 5""").fetchall()
        top = FA.factor_top_items(run.models[m], 5, 5, merchant_info_of(run, con))
        close(rows(top.select("factor", "rank", "merchant_id", "weight", "merchant_city", "mcc_description")), want, 1e-12)


def merchant_info_of(run, con):
    return run.eval.recs.sparkSession.createDataFrame(con.execute("SELECT * FROM info").fetchdf().astype(object).where(lambda x: x.notna(), None),
        "merchant_id bigint, merchant_city string, merchant_state string, mcc int, mcc_description string")


def test_metrics_and_comparison_of_all_models(written):
    run, con = written
    ranking = EV.ranking_metrics(run.eval.recs, run.eval.relevant, run.eval.users, models=run.eval.models)
    metrics = EV.metrics_long(ranking, EV.coverage(run.eval.recs, run.eval.n_items, 10), EVP.mf_errors(run))
    ctes = O.ranking_ctes()
    con.execute("CREATE OR REPLACE VIEW rel AS SELECT client_id, merchant_id FROM test")
    con.execute("CREATE OR REPLACE VIEW ix AS SELECT * FROM ratings")
    want = con.execute(O.with_(ctes, "SELECT model, k, n_users, precision, recall, f1 FROM ranking")).fetchall()
    close(rows(ranking), want)
    errors = "SELECT model, 'rmse' AS metric, CAST(NULL AS INTEGER) AS k, sqrt(avg((rating - prediction) ** 2)) AS value FROM pred GROUP BY 1"
    best = con.execute(O.with_(ctes + [f"every AS (SELECT * FROM metrics UNION ALL {errors})"], """SELECT metric, k, model, value FROM (
        SELECT *, row_number() OVER (PARTITION BY metric, k ORDER BY CASE WHEN metric = 'rmse' THEN value ELSE -value END, model) AS rn FROM every) q
        WHERE rn = 1""")).fetchall()
    close(rows(EV.best_by_metric(metrics).where("metric <> 'mae'")), best)
