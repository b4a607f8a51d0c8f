"""Registered queries: one Spark job per operator of the survey inventory,
each paired (where SQL can say it) with its DuckDB twin in ``SQL``.

Every query reads the whole driver tables; limits appear only where a
top-N list is the feature.  Doubles are rounded to 6 digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics as AN
from ..operators import interactions as IN
from ..operators import neighbors as NB
from ..operators import profile as PR
from ..operators import similarity as SI
from ..operators.clean import merchant_info
from ..sources import adapters as A
from ..session import reliable
from . import base
from . import oracle as O

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def q(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return deco


def r6(c: str, alias: str | None = None):
    return F.round(F.col(c), 6).alias(alias or c)


W = O.with_
TXB = O.BASE_TX
IXB = O.BASE_IX

# ----------------------------------------------------------------------------
# cleaning and lookups
# ----------------------------------------------------------------------------


@q("c01_clean_transactions", W(TXB, "SELECT * FROM tx"))
def c01(spark, sf):
    return base.tx(spark, sf)


@q("c07_event_date_parts", W([O.EV], "SELECT id, date, client_id, amount, merchant_id, mcc_description, year, month, day, hour, day_of_week, amount_category FROM ev"))
def c07(spark, sf):
    return base.ev(spark, sf).select(
        "id", "date", "client_id", "amount", "merchant_id", "mcc_description",
        "year", "month", "day", "hour", "day_of_week", "amount_category",
    )


@q("j02_merchant_info", W(TXB, """SELECT merchant_id, merchant_city, merchant_state, mcc, mcc_description FROM (
  SELECT *, row_number() OVER (PARTITION BY merchant_id ORDER BY date NULLS FIRST, id NULLS FIRST,
     merchant_city NULLS FIRST, merchant_state NULLS FIRST, mcc NULLS FIRST, mcc_description NULLS FIRST) AS rn
  FROM tx) q WHERE rn = 1"""))
def j02(spark, sf):
    return merchant_info(base.tx(spark, sf))


# ----------------------------------------------------------------------------
# profiling
# ----------------------------------------------------------------------------

_TX_COLS = ["id", "date", "client_id", "amount", "merchant_id", "merchant_city", "merchant_state", "mcc",
            "is_fraud", "mcc_description", "year", "month", "day", "hour", "day_of_week", "amount_category"]
_NULLS_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS n_null FROM tx" for c in _TX_COLS
)


@q("b02_null_counts", W(TXB, _NULLS_SQL))
def b02(spark, sf):
    return PR.null_counts(base.tx(spark, sf))


@q("b03_top_null_columns", W(TXB, f"SELECT * FROM ({_NULLS_SQL}) q ORDER BY n_null DESC, column_name LIMIT 10"))
def b03(spark, sf):
    return PR.top_null_columns(base.tx(spark, sf), 10)


_NULLS_EV_SQL = _NULLS_SQL.replace("FROM tx", "FROM ev")


@q("b02_null_counts_events", W([O.EV], _NULLS_EV_SQL))
def b02e(spark, sf):
    """Events carry no place and no code: whole columns are null."""
    return PR.null_counts(base.ev(spark, sf))


@q("b03_top_null_columns_events", W([O.EV], f"SELECT * FROM ({_NULLS_EV_SQL}) q ORDER BY n_null DESC, column_name LIMIT 10"))
def b03e(spark, sf):
    return PR.top_null_columns(base.ev(spark, sf), 10)


@q("b09_drop_incomplete_events", W([O.EV], "SELECT id, date, client_id, amount, merchant_id FROM ev WHERE id IS NOT NULL AND date IS NOT NULL AND client_id IS NOT NULL AND amount IS NOT NULL AND merchant_id IS NOT NULL"))
def b09e(spark, sf):
    return PR.drop_incomplete(base.ev(spark, sf).select("id", "date", "client_id", "amount", "merchant_id"))


_NUM_COLS = ["id", "client_id", "amount", "merchant_id", "mcc", "is_fraud", "year", "month", "day", "hour", "day_of_week"]
_DESCRIBE_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count({c}) AS count, round(avg(CAST({c} AS DOUBLE)), 4) AS mean,
  round(stddev_samp(CAST({c} AS DOUBLE)), 4) AS std, min(CAST({c} AS DOUBLE)) AS min,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS q25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS q50,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS q75, max(CAST({c} AS DOUBLE)) AS max FROM tx"""
    for c in _NUM_COLS
)


@q("b04_describe_numeric", W(TXB, _DESCRIBE_SQL))
def b04(spark, sf):
    return PR.describe_numeric(base.tx(spark, sf), _NUM_COLS)


@q("b06_shape", W(TXB, "SELECT count(*) AS n_rows, 16 AS n_cols FROM tx"))
def b06(spark, sf):
    return PR.shape(base.tx(spark, sf))


@q("b07_preview", W(TXB, "SELECT * FROM tx ORDER BY " + ", ".join(f"{c} NULLS FIRST" for c in _TX_COLS) + " LIMIT 5"))
def b07(spark, sf):
    return PR.preview(base.tx(spark, sf), 5)


@q("b09_drop_incomplete", W(TXB, "SELECT * FROM tx WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _TX_COLS)))
def b09(spark, sf):
    return PR.drop_incomplete(base.tx(spark, sf))


@q("b10_label_counts", W([O.LAB], "SELECT label, count(*) AS n FROM lab WHERE label IS NOT NULL GROUP BY label"))
def b10(spark, sf):
    return PR.value_counts(A.retail_labels(spark, sf), "label")


# ----------------------------------------------------------------------------
# interaction tables
# ----------------------------------------------------------------------------


@q("d01_interactions", W(IXB, "SELECT * FROM ix"))
def d01(spark, sf):
    return IN.interactions(base.tx_plain(spark, sf))


@q("d02_category_interactions", W(TXB, f"""SELECT client_id, mcc, count(amount) AS transaction_count,
  {O.msum('amount')} AS total_amount FROM tx WHERE client_id IS NOT NULL AND mcc IS NOT NULL GROUP BY client_id, mcc"""))
def d02(spark, sf):
    return IN.category_interactions(base.tx_plain(spark, sf))


@q("d03_pair_counts", W(TXB, """SELECT client_id, merchant_id, count(*) AS count FROM tx
  WHERE client_id IS NOT NULL AND merchant_id IS NOT NULL GROUP BY client_id, merchant_id"""))
def d03(spark, sf):
    return IN.pair_counts(base.tx_plain(spark, sf))


@q("d04_category_counts", W(TXB, """SELECT client_id, mcc, count(*) AS count FROM tx
  WHERE client_id IS NOT NULL AND mcc IS NOT NULL GROUP BY client_id, mcc"""))
def d04(spark, sf):
    return IN.pair_counts(base.tx_plain(spark, sf), item="mcc")


@q("d05_pair_stats", W(TXB, f"""SELECT client_id, merchant_id, count(abs(amount)) AS frequency,
  round({O.msum('abs(amount)')} / count(abs(amount)), 6) AS avg_amount, {O.msum('abs(amount)')} AS total_amount
  FROM tx WHERE client_id IS NOT NULL AND merchant_id IS NOT NULL GROUP BY client_id, merchant_id"""))
def d05(spark, sf):
    return IN.pair_stats(base.tx_plain(spark, sf)).withColumn("avg_amount", F.round("avg_amount", 6))


_N_CODES = 25  # nation dimension of the driver data: codes 0..24


@q("d06_category_pivot", W(TXB, "SELECT client_id, " + ", ".join(
    f"CAST(coalesce(sum(CASE WHEN mcc = {k} THEN 1 ELSE 0 END), 0) AS BIGINT) AS mcc_{k}" for k in range(_N_CODES)
) + " FROM tx WHERE client_id IS NOT NULL AND mcc IS NOT NULL GROUP BY client_id"))
def d06(spark, sf):
    codes = [int(r[0]) for r in A.retail_codes(spark, sf).select("mcc").collect()]  # dimension: bounded
    codes.sort()
    cat = IN.pair_counts(base.tx_plain(spark, sf), item="mcc")
    return IN.pivot_counts(cat, "client_id", "mcc", codes, value="count", prefix="mcc_")


@q("d07_matrix_stats", W(IXB, """SELECT count(DISTINCT client_id) AS n_users, count(DISTINCT merchant_id) AS n_items,
  count(*) AS nnz, 1.0 - count(*) / (CAST(count(DISTINCT client_id) AS DOUBLE) * count(DISTINCT merchant_id)) AS sparsity
  FROM ix"""))
def d07(spark, sf):
    return IN.matrix_stats(base.ix(spark, sf))


# ----------------------------------------------------------------------------
# descriptive analytics
# ----------------------------------------------------------------------------


@q("d08_hourly", W([O.EV], "SELECT hour, count(*) AS n FROM ev WHERE hour IS NOT NULL GROUP BY hour"))
def d08(spark, sf):
    return AN.per_hour(base.ev(spark, sf))


@q("d09_weekday", W(TXB, """SELECT CAST(d.range AS INTEGER) AS day_of_week,
  ['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][d.range + 1] AS day_name, coalesce(c.n, 0) AS n
  FROM range(7) d LEFT JOIN (SELECT day_of_week, count(*) AS n FROM tx WHERE day_of_week IS NOT NULL
  GROUP BY day_of_week) c ON c.day_of_week = d.range"""))
def d09(spark, sf):
    return AN.per_weekday(spark, base.tx_plain(spark, sf))


def _ellipsize_sql(c: str, n: int) -> str:
    return f"CASE WHEN length({c}) > {n} THEN substr({c}, 1, {n}) || '...' ELSE {c} END"


@q("d10_top_categories", W(TXB, f"""SELECT mcc_description, n, {_ellipsize_sql('mcc_description', 20)} AS label FROM (
  SELECT mcc_description, count(*) AS n FROM tx WHERE mcc_description IS NOT NULL GROUP BY 1) q
  ORDER BY n DESC, mcc_description LIMIT 10"""))
def d10(spark, sf):
    return AN.top_values(base.tx(spark, sf), "mcc_description", 10, label_chars=20)


@q("d11_fraud_share", W(TXB, """SELECT is_fraud, n, round(n * 100.0 / sum(n) OVER (), 6) AS pct FROM (
  SELECT is_fraud, count(*) AS n FROM tx GROUP BY is_fraud) q"""))
def d11(spark, sf):
    return AN.fraud_share(base.tx(spark, sf))


@q("d12_amount_buckets", W(TXB, """SELECT amount_category, count(*) AS n FROM tx
  WHERE amount_category IS NOT NULL GROUP BY amount_category"""))
def d12(spark, sf):
    return AN.amount_buckets(base.tx_plain(spark, sf))


@q("d13_monthly", W(TXB, f"""SELECT month, ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][month]
  AS month_name, count(amount) AS n, {O.msum('amount')} AS total_amount FROM tx WHERE month IS NOT NULL GROUP BY month"""))
def d13(spark, sf):
    return AN.monthly(base.tx_plain(spark, sf))


@q("d14_category_stats", W(TXB, f"""SELECT mcc_description AS category, count(amount) AS frequency,
  round({O.msum('amount')} / count(amount), 6) AS avg_amount FROM tx WHERE mcc_description IS NOT NULL
  GROUP BY mcc_description ORDER BY frequency DESC, category LIMIT 15"""))
def d14(spark, sf):
    return AN.category_stats(base.tx(spark, sf), 15)


def _hist_sql(values: str, bins: int) -> str:
    """``values`` is a query yielding column x."""
    return f"""WITH v AS (SELECT x FROM ({values}) q WHERE x IS NOT NULL),
s0 AS (SELECT min(x) AS mn, max(x) AS mx FROM v),
s AS (SELECT CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo, CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi FROM s0),
c AS (SELECT CAST(least(floor((x - lo) / (hi - lo) * {bins}), {bins - 1}) AS INTEGER) AS bin, count(*) AS n
      FROM v CROSS JOIN s GROUP BY 1)
SELECT CAST(r.range AS INTEGER) AS bin, round(lo + r.range * ((hi - lo) / {bins}), 6) AS bin_lo,
       round(lo + (r.range + 1) * ((hi - lo) / {bins}), 6) AS bin_hi, coalesce(c.n, 0) AS n
FROM range({bins}) r CROSS JOIN s LEFT JOIN c ON c.bin = r.range"""


def _hist_with(ctes: list[str], values: str, bins: int) -> str:
    inner = _hist_sql(values, bins)
    # splice the base CTEs in front of the histogram's own CTEs
    return "WITH " + ",\n".join(ctes) + ",\n" + inner[len("WITH "):]


@q("d15_amount_histogram", _hist_with(TXB, "SELECT CASE WHEN amount IS NULL THEN NULL ELSE least(greatest(amount, -1000.0), 1000.0) END AS x FROM tx", 50))
def d15a(spark, sf):
    return AN.histogram(spark, base.tx_plain(spark, sf), "amount", 50, clip_range=(-1000.0, 1000.0))


@q("d15_user_tx_histogram", _hist_with(TXB, "SELECT CAST(count(*) AS DOUBLE) AS x FROM tx WHERE client_id IS NOT NULL GROUP BY client_id", 30))
def d15b(spark, sf):
    return AN.histogram(spark, AN.per_user_counts(base.tx_plain(spark, sf)), "n", 30)


@q("d15_merchant_pop_histogram", _hist_with(TXB, "SELECT CAST(count(*) AS DOUBLE) AS x FROM tx WHERE merchant_id IS NOT NULL GROUP BY merchant_id", 50))
def d15c(spark, sf):
    return AN.histogram(spark, AN.merchant_popularity(base.tx_plain(spark, sf)), "n", 50)


@q("d15_income_histogram", _hist_sql("SELECT CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS x FROM customer", 30))
def d15d(spark, sf):
    from ..functions.scalar import parse_money

    users = A.retail_users(spark, sf).select(parse_money("yearly_income").alias("income"))
    return AN.histogram(spark, users, "income", 30)


@q("d15_credit_limit_histogram", _hist_sql("SELECT CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS x FROM customer", 30))
def d15e(spark, sf):
    from ..functions.scalar import parse_money

    cards = A.retail_cards(spark, sf).select(parse_money("credit_limit").alias("credit_limit"))
    return AN.histogram(spark, cards, "credit_limit", 30)


_INCOME_ACTIVITY = """pairs AS (
  SELECT CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS income, CAST(t.n AS DOUBLE) AS n_tx
  FROM customer JOIN (SELECT client_id, count(*) AS n FROM tx WHERE client_id IS NOT NULL GROUP BY 1) t ON c_custkey = t.client_id)"""


def _income_activity(spark, sf):
    """Income of each customer and, as the driver data have no credit score, the number of their transactions."""
    from ..functions.scalar import parse_money

    users = A.retail_users(spark, sf).select(F.col("id").alias("client_id"), parse_money("yearly_income").alias("income"))
    return users.join(AN.per_user_counts(base.tx_plain(spark, sf)), "client_id").select("income", F.col("n").cast("double").alias("n_tx"))


@q("d25_income_vs_activity_bins", W(TXB + [_INCOME_ACTIVITY], """SELECT CAST(floor(income / 1000) AS BIGINT) AS x_bin,
  CAST(floor(n_tx / 10) AS BIGINT) AS y_bin, count(*) AS n FROM pairs WHERE income IS NOT NULL GROUP BY 1, 2"""))
def d25(spark, sf):
    return AN.binned_pairs(_income_activity(spark, sf), "income", "n_tx", 1000, 10)


@q("d25_income_vs_activity_corr", W(TXB + [_INCOME_ACTIVITY], "SELECT count(*) AS n, round(corr(income, n_tx), 6) AS corr FROM pairs WHERE income IS NOT NULL"))
def d25b(spark, sf):
    return AN.pair_correlation(_income_activity(spark, sf), "income", "n_tx")


@q("d16_card_type_share", """SELECT c_mktsegment AS card_type, n, round(n / sum(n) OVER (), 6) AS share FROM (
  SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1) q""")
def d16(spark, sf):
    return AN.share_table(A.retail_cards(spark, sf), "card_type")


@q("d17_top_states", W(TXB, """SELECT merchant_state, count(*) AS n FROM tx WHERE merchant_state IS NOT NULL
  GROUP BY 1 ORDER BY n DESC, merchant_state LIMIT 10"""))
def d17(spark, sf):
    return AN.top_values(base.tx_plain(spark, sf), "merchant_state", 10)


@q("d18_dataset_summary", W(TXB, f"""SELECT count(*) AS n_transactions, count(DISTINCT client_id) AS n_users,
  count(DISTINCT merchant_id) AS n_merchants, count(DISTINCT mcc) AS n_categories,
  CAST(sum(is_fraud) AS BIGINT) AS n_fraud, round(avg(is_fraud) * 100.0, 6) AS fraud_pct,
  round({O.msum('amount')} / count(amount), 6) AS avg_amount, {O.msum('amount')} AS total_amount,
  strftime(min(date), '%Y-%m-%d') AS first_date, strftime(max(date), '%Y-%m-%d') AS last_date FROM tx"""))
def d18(spark, sf):
    return AN.dataset_summary(base.tx(spark, sf))


@q("d19_demographics", f"""SELECT 'avg_age' AS metric, CAST(NULL AS DOUBLE) AS value
  UNION ALL SELECT 'avg_income', round({O.msum('c_acctbal')} / count(c_acctbal), 6) FROM customer
  UNION ALL SELECT 'avg_credit_score', CAST(NULL AS DOUBLE)
  UNION ALL SELECT 'n_cards', CAST(count(*) AS DOUBLE) FROM customer
  UNION ALL SELECT 'avg_credit_limit', round({O.msum('c_acctbal')} / count(c_acctbal), 6) FROM customer""")
def d19(spark, sf):
    return AN.demographics(A.retail_users(spark, sf), A.retail_cards(spark, sf))


@q("d20_tx_per_user", W(TXB, "SELECT client_id, count(*) AS n FROM tx WHERE client_id IS NOT NULL GROUP BY 1"))
def d20(spark, sf):
    return AN.per_user_counts(base.tx_plain(spark, sf))


@q("d21_merchant_popularity", W(TXB, "SELECT merchant_id, count(*) AS n FROM tx WHERE merchant_id IS NOT NULL GROUP BY 1"))
def d21(spark, sf):
    return AN.merchant_popularity(base.tx_plain(spark, sf))


@q("d22_cold_start", W(TXB, """SELECT count(*) AS n_users, CAST(sum(CASE WHEN n < 5 THEN 1 ELSE 0 END) AS BIGINT) AS users_lt_threshold,
  round(avg(CASE WHEN n < 5 THEN 1.0 ELSE 0.0 END) * 100.0, 6) AS pct_lt_threshold,
  CAST(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS BIGINT) AS single_tx_users, round(avg(n), 6) AS mean_tx_per_user
  FROM (SELECT client_id, count(*) AS n FROM tx WHERE client_id IS NOT NULL GROUP BY 1) u"""))
def d22(spark, sf):
    return AN.cold_start(base.tx_plain(spark, sf))


@q("d23_single_tx_merchants", W(TXB, """SELECT count(*) AS n_merchants,
  CAST(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS BIGINT) AS single_tx_merchants
  FROM (SELECT merchant_id, count(*) AS n FROM tx WHERE merchant_id IS NOT NULL GROUP BY 1) m"""))
def d23(spark, sf):
    return AN.single_tx_merchants(base.tx_plain(spark, sf))


@q("d24_category_user_diversity", W(TXB, f"""SELECT category, n_users, {_ellipsize_sql('category', 20)} AS label FROM (
  SELECT mcc_description AS category, count(DISTINCT client_id) AS n_users FROM tx
  WHERE mcc_description IS NOT NULL GROUP BY 1) q ORDER BY n_users DESC, category LIMIT 15"""))
def d24(spark, sf):
    return AN.category_user_diversity(base.tx(spark, sf), 15, 20)


@q("d26_characteristics", W(TXB, """SELECT count(DISTINCT client_id) AS total_users,
  count(DISTINCT merchant_id) AS total_merchants, round(count(*) / count(DISTINCT client_id), 6) AS avg_tx_per_user FROM tx"""))
def d26(spark, sf):
    return AN.characteristics(base.tx_plain(spark, sf))


@q("d27_user_profile", W(TXB, f"""SELECT client_id, count(*) AS n_transactions, {O.msum('amount')} AS total_amount,
  round({O.msum('amount')} / count(amount), 6) AS avg_amount, count(DISTINCT merchant_id) AS n_merchants
  FROM tx WHERE client_id IS NOT NULL GROUP BY client_id"""))
def d27(spark, sf):
    return AN.user_profile(base.tx_plain(spark, sf))


@q("d28_user_top_categories", W(TXB, """SELECT client_id, mcc_description, n, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY n DESC, mcc_description) AS rank FROM (
    SELECT client_id, mcc_description, count(*) AS n FROM tx
    WHERE client_id IS NOT NULL AND mcc_description IS NOT NULL GROUP BY 1, 2) g) q WHERE rank <= 5"""))
def d28(spark, sf):
    return AN.user_top_categories(base.tx(spark, sf), 5)


@q("d29_user_top_merchants", W(TXB, """SELECT client_id, merchant_id, merchant_city, mcc_description, n,
  CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY n DESC, merchant_id, merchant_city, mcc_description) AS rank
  FROM (SELECT client_id, merchant_id, merchant_city, mcc_description, count(*) AS n FROM tx
        WHERE client_id IS NOT NULL AND merchant_id IS NOT NULL AND merchant_city IS NOT NULL
          AND mcc_description IS NOT NULL GROUP BY 1, 2, 3, 4) g) q WHERE rank <= 5"""))
def d29(spark, sf):
    return AN.user_top_merchants(base.tx(spark, sf), 5)


# ----------------------------------------------------------------------------
# long tail
# ----------------------------------------------------------------------------

_LT_SQL = """lt AS (
  SELECT row_number() OVER (ORDER BY n DESC, merchant_id) AS rank, merchant_id, n,
         round(sum(n) OVER (ORDER BY n DESC, merchant_id ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 6) AS cum_share
  FROM (SELECT merchant_id, count(*) AS n FROM tx WHERE merchant_id IS NOT NULL GROUP BY 1) p)"""


@q("w01_long_tail", W(TXB + [_LT_SQL], "SELECT * FROM lt"))
def w01(spark, sf):
    return AN.long_tail(base.tx_plain(spark, sf))


@q("w02_share_at_20pct", W(TXB + [_LT_SQL], """SELECT m.n_merchants, CAST(floor(m.n_merchants * 0.2) AS BIGINT) AS position,
  lt.cum_share AS share_at_rank FROM (SELECT count(*) AS n_merchants FROM lt) m
  JOIN lt ON lt.rank = CAST(floor(m.n_merchants * 0.2) AS BIGINT) + 1"""))
def w02(spark, sf):
    return AN.share_at_rank(base.tx_plain(spark, sf), 0.2)


@q("w03_pareto_point", W(TXB + [_LT_SQL], """SELECT min(CASE WHEN cum_share >= 0.8 THEN rank END) AS rank_at_share,
  count(*) AS n_merchants, round(min(CASE WHEN cum_share >= 0.8 THEN rank END) / count(*), 6) AS merchant_fraction FROM lt"""))
def w03(spark, sf):
    return AN.pareto_point(base.tx_plain(spark, sf), 0.8)


# ----------------------------------------------------------------------------
# ratings, index, split
# ----------------------------------------------------------------------------

_RATINGS_SQL = f"""rt0 AS (
  SELECT client_id, merchant_id, count(abs(amount)) AS frequency,
         {O.msum('abs(amount)')} / count(abs(amount)) AS avg_amount, {O.msum('abs(amount)')} AS total_amount
  FROM tx WHERE client_id IS NOT NULL AND merchant_id IS NOT NULL GROUP BY client_id, merchant_id),
rt AS (
  SELECT client_id, merchant_id, frequency, avg_amount, total_amount,
         1.0 + 4.0 * ((frequency * ln(1 + avg_amount)) / max(frequency * ln(1 + avg_amount)) OVER ()) AS rating
  FROM rt0)"""


@q("f01_ratings", W(TXB + [_RATINGS_SQL], """SELECT client_id, merchant_id, frequency, round(avg_amount, 6) AS avg_amount,
  total_amount, round(rating, 6) AS rating FROM rt"""))
def f01(spark, sf):
    r = IN.ratings(base.tx_plain(spark, sf))
    return r.select("client_id", "merchant_id", "frequency", r6("avg_amount"), "total_amount", r6("rating"))


@q("d30_rating_stats", W(TXB + [_RATINGS_SQL], """SELECT round(min(rating), 6) AS min_rating, round(max(rating), 6) AS max_rating,
  round(avg(rating), 6) AS mean_rating FROM rt"""))
def d30(spark, sf):
    r = IN.ratings(base.tx_plain(spark, sf))
    return r.agg(
        F.round(F.min("rating"), 6).alias("min_rating"),
        F.round(F.max("rating"), 6).alias("max_rating"),
        F.round(F.avg("rating"), 6).alias("mean_rating"),
    )


@q("f02_item_index", W(IXB, """SELECT merchant_id, row_number() OVER (ORDER BY merchant_id) - 1 AS merchant_id_idx
  FROM (SELECT DISTINCT merchant_id FROM ix) d"""))
def f02(spark, sf):
    return IN.index_ids(base.ix(spark, sf), "merchant_id")


@q("f05_split", W(TXB + [_RATINGS_SQL], f"""SELECT client_id, merchant_id, round(rating, 6) AS rating,
  ({O.hash_key('split', 'client_id', 'merchant_id')} % 10000) < 3000 AS is_test FROM rt"""))
def f05(spark, sf):
    r = IN.split_interactions(IN.ratings(base.tx_plain(spark, sf)), 0.3, salt="split")
    return r.select("client_id", "merchant_id", r6("rating"), "is_test")


@q("f05_split_by_time", W(TXB, """SELECT id, client_id, merchant_id, date, amount,
  coalesce(date > (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS r, count(*) OVER () AS n FROM tx WHERE date IS NOT NULL) o
                   WHERE r = floor((n - 1) * 0.8 + 1e-9)), false) AS is_test FROM tx"""))
def f05b(spark, sf):
    """Train before one moment, test after it."""
    t = base.tx_plain(spark, sf).select("id", "client_id", "merchant_id", "date", "amount")
    return IN.split_by_time(t, 0.2)


@q("f05_leave_last", W(TXB, """SELECT id, client_id, merchant_id, date, coalesce(n >= 2 AND date = last_date AND id = last_id, false) AS is_test
  FROM (SELECT *, count(date) OVER (PARTITION BY client_id) AS n,
               first_value(date) OVER (PARTITION BY client_id ORDER BY date DESC NULLS LAST, id DESC) AS last_date,
               first_value(id) OVER (PARTITION BY client_id ORDER BY date DESC NULLS LAST, id DESC) AS last_id FROM tx) t"""))
def f05c(spark, sf):
    """The last transaction of every user as test."""
    return IN.leave_last(base.tx_plain(spark, sf).select("id", "client_id", "merchant_id", "date"))


# ----------------------------------------------------------------------------
# similarity and neighbourhood recommenders
# ----------------------------------------------------------------------------


@q("e01_user_similarity", W(IXB + O.cosine_ctes("us", "ix", "client_id", "merchant_id"),
                             "SELECT a AS user_a, b AS user_b, round(sim, 6) AS sim FROM us"))
def e01(spark, sf):
    s = SI.user_similarity(base.cf(spark, sf))
    return s.select("user_a", "user_b", r6("sim"))


@q("e02_item_similarity", W(IXB + O.cosine_ctes("isim", "ix", "merchant_id", "client_id"),
                             "SELECT a AS item_a, b AS item_b, round(sim, 6) AS sim FROM isim"))
def e02(spark, sf):
    s = SI.item_similarity(base.cf(spark, sf))
    return s.select("item_a", "item_b", r6("sim"))


@q("e01_user_similarity_above", W(IXB + O.cosine_ctes("us", "ix", "client_id", "merchant_id"),
                                   "SELECT a AS user_a, b AS user_b, round(sim, 6) AS sim FROM us WHERE sim > 0.25"))
def e01b(spark, sf):
    """Pairs above a cosine of 0.25, by prefixes."""
    return SI.user_similarity(base.cf(spark, sf), min_sim=0.25).select("user_a", "user_b", r6("sim"))


@q("e02_item_similarity_above", W(IXB + O.cosine_ctes("isim", "ix", "merchant_id", "client_id"),
                                   "SELECT a AS item_a, b AS item_b, round(sim, 6) AS sim FROM isim WHERE sim > 0.25"))
def e02b(spark, sf):
    return SI.item_similarity(base.cf(spark, sf), min_sim=0.25).select("item_a", "item_b", r6("sim"))


@q("e02_item_similarity_sampled")
def e02c(spark, sf):
    """The opt-in estimate by dimension-independent sampling, for cosines from 0.1."""
    return SI.approximate_item_pairs(base.cf(spark, sf), 0.1).select("item_a", "item_b", r6("sim"))


@q("e03_nearest_users", W(IXB + O.cosine_ctes("us", "ix", "client_id", "merchant_id") + [O.nearest_cte("nb", "us", 10)],
                           "SELECT id AS client_id, neighbor AS neighbor_id, round(sim, 6) AS sim, CAST(rank AS INTEGER) AS rank FROM nb"))
def e03(spark, sf):
    nb = SI.nearest_neighbors(base.cf(spark, sf), n=10)
    return nb.select(F.col("id").alias("client_id"), F.col("neighbor").alias("neighbor_id"), r6("sim"), "rank")


@q("e04_nearest_items", W(IXB + O.cosine_ctes("isim", "ix", "merchant_id", "client_id") + [O.nearest_cte("nb", "isim", 10)],
                           "SELECT id AS merchant_id, neighbor AS neighbor_id, round(sim, 6) AS sim, CAST(rank AS INTEGER) AS rank FROM nb"))
def e04(spark, sf):
    nb = SI.nearest_neighbors(base.cf(spark, sf), "merchant_id", "client_id", n=10)
    return nb.select(F.col("id").alias("merchant_id"), F.col("neighbor").alias("neighbor_id"), r6("sim"), "rank")


def _recs_out(df: DataFrame) -> DataFrame:
    return df.select("client_id", "rank", "merchant_id", r6("score"))


@q("e05_recommend_user_based", W(IXB + O.user_based_ctes("ub", "ix"), O.top_n("ub", 10)))
def e05(spark, sf):
    return _recs_out(NB.recommend_user_based(base.cf(spark, sf)))


@q("e06_recommend_item_based", W(IXB + O.item_based_ctes("ib", "ix"), O.top_n("ib", 10)))
def e06(spark, sf):
    return _recs_out(NB.recommend_item_based(base.cf(spark, sf)))


@q("e07_recommend_popular", W(IXB + O.popular_ctes("pp", "ix"), O.top_n("pp", 10)))
def e07(spark, sf):
    return _recs_out(NB.recommend_popular(base.cf(spark, sf)))


@q("e08_enriched_user_based", W(IXB + O.user_based_ctes("ub", "ix") + [
    """mi AS (SELECT merchant_id, merchant_city, merchant_state, mcc, mcc_description FROM (
  SELECT *, row_number() OVER (PARTITION BY merchant_id ORDER BY date NULLS FIRST, id NULLS FIRST,
     merchant_city NULLS FIRST, merchant_state NULLS FIRST, mcc NULLS FIRST, mcc_description NULLS FIRST) AS rn
  FROM tx) q WHERE rn = 1)""", "top AS (" + O.top_n("ub", 10) + ")"],
    "SELECT top.*, mi.merchant_city, mi.merchant_state, mi.mcc, mi.mcc_description FROM top LEFT JOIN mi USING (merchant_id)"))
def e08(spark, sf):
    t = base.tx(spark, sf)
    recs = _recs_out(NB.recommend_user_based(IN.interactions(t)))
    return NB.enrich(recs, merchant_info(t))


# ----------------------------------------------------------------------------
# evaluation of the neighbourhood and popularity models
# ----------------------------------------------------------------------------

from ..operators import evaluate as EV  # noqa: E402
from . import evaluation as EVP  # noqa: E402

_EVAL = IXB + O.holdout_ctes() + O.cf_recs_ctes() + O.ranking_ctes()


@q("g01_holdout", W(IXB + O.holdout_ctes(), "SELECT client_id, merchant_id, n_items, is_holdout FROM split"))
def g01(spark, sf):
    return EV.holdout_per_user(base.cf(spark, sf)).select("client_id", "merchant_id", "n_items", "is_holdout")


@q("g03_sample_users", W(IXB, f"SELECT client_id FROM (SELECT DISTINCT client_id FROM ix) u ORDER BY {O.hash_key('users', 'client_id')}, client_id LIMIT 100"))
def g03(spark, sf):
    """A repeatable sample of 100 evaluation users (sampling is the feature)."""
    return EV.sample_users(base.cf(spark, sf), 100)


@q("g04_ranking_metrics", W(_EVAL, "SELECT * FROM ranking"))
def g04(spark, sf):
    return EVP.cf_metrics(EVP.cf_run(base.cf(spark, sf)))[0]


@q("g06_coverage", W(_EVAL, "SELECT * FROM cov"))
def g06(spark, sf):
    return EVP.cf_metrics(EVP.cf_run(base.cf(spark, sf)))[1]


_CMP_SQL = "SELECT model, " + ", ".join(
    (f"max(CASE WHEN metric = '{m}' AND k = {k} THEN value END) AS {m}_{k}" if k else
     f"max(CASE WHEN metric = '{m}' AND k IS NULL THEN value END) AS {m}")
    for m, k in EV.COMPARE_COLUMNS
) + " FROM metrics GROUP BY model"


@q("g07_compare_models", W(_EVAL, _CMP_SQL))
def g07(spark, sf):
    return EV.compare_models(EVP.cf_metrics(EVP.cf_run(base.cf(spark, sf)))[2])


@q("g08_best_by_metric", W(_EVAL, """SELECT metric, k, model AS best_model, value AS best_value FROM (
  SELECT *, row_number() OVER (PARTITION BY metric, k
            ORDER BY CASE WHEN metric IN ('rmse', 'mae') THEN value ELSE -value END, model) AS rn
  FROM metrics WHERE value IS NOT NULL) q WHERE rn = 1"""))
def g08(spark, sf):
    return EV.best_by_metric(EVP.cf_metrics(EVP.cf_run(base.cf(spark, sf)))[2])


@q("g09_recall_series", W(_EVAL, """SELECT k, max(CASE WHEN model = 'item_based' THEN value END) AS item_based,
  max(CASE WHEN model = 'popularity' THEN value END) AS popularity,
  max(CASE WHEN model = 'user_based' THEN value END) AS user_based
  FROM metrics WHERE metric = 'recall' AND k IS NOT NULL GROUP BY k"""))
def g09(spark, sf):
    run = EVP.cf_run(base.cf(spark, sf))
    return EV.metric_series(EVP.cf_metrics(run)[2], "recall", run.models)


@q("g10_diversity", W(_EVAL, """SELECT model, count(*) AS n_users, round(avg(d), 6) AS diversity FROM (
  SELECT x.model, x.client_id, avg(1.0 - coalesce(s.sim, 0.0)) AS d
  FROM recs x JOIN recs y ON x.model = y.model AND x.client_id = y.client_id AND x.merchant_id < y.merchant_id
  LEFT JOIN ib_is s ON s.a = x.merchant_id AND s.b = y.merchant_id
  WHERE x.rank <= 10 AND y.rank <= 10 GROUP BY x.model, x.client_id) l GROUP BY model"""))
def g10(spark, sf):
    """How unlike each other the items of a list are, by the training interactions."""
    run = EVP.cf_run(base.cf(spark, sf))
    return EV.list_diversity(run.recs, run.train)


_SELF = IXB + O.holdout_ctes(divisor=2, min_items=2, salt="selfeval") + O.cf_recs_ctes(("user_based",), 10) + O.ranking_ctes((10,))


@q("g11_cf_self_eval", W(_SELF, "SELECT * FROM ranking"))
def g11(spark, sf):
    run = EVP.cf_run(base.cf(spark, sf), n=10, divisor=2, min_items=2, models=("user_based",), salt="selfeval")
    return EV.ranking_metrics(run.recs, run.relevant, run.users, (10,), models=run.models)


# ----------------------------------------------------------------------------
# latent-factor models (F6-F13, D31, G4/G7/G8/G12 over all models).  No SQL
# twin: tests/test_factors.py holds them against NumPy and DuckDB.
# ----------------------------------------------------------------------------

from ..operators import factors as FA  # noqa: E402

def _ratings(spark, sf):
    return IN.ratings(base.tx_plain(spark, sf))


def _mf(spark, sf, models=("svd", "nmf"), k: int = 20):
    """The evaluation run of the named models, fitted anew for each query."""
    return EVP.mf_run(_ratings(spark, sf), k=k, models=models)


@q("f06_svd_singular_values")
def f06(spark, sf):
    m = _mf(spark, sf, ("svd",)).models["svd"]
    rows = [(j, float(s)) for j, s in enumerate(m.sigma)]
    return spark.createDataFrame(rows, "factor int, singular_value double")


@q("f07_explained_variance")
def f07(spark, sf):
    m = _mf(spark, sf, ("svd",)).models["svd"]
    return spark.createDataFrame([(m.k, float(m.explained_variance_ratio))], "k int, explained_variance_ratio double")


@q("f08_nmf_fit")
def f08(spark, sf):
    m = _mf(spark, sf, ("nmf",)).models["nmf"]
    rows = [(m.k, m.n_iter, m.converged, float(m.reconstruction_err))]
    return spark.createDataFrame(rows, "k int, iterations int, converged boolean, reconstruction_err double")


@q("f08_als_fit")
def f08b(spark, sf):
    """Block ALS over the observed cells, and its error on the shared holdout."""
    run = _mf(spark, sf, ("als",))
    m = run.models["als"]
    fit = F.struct(F.lit(m.k).alias("k"), F.lit(m.n_iter).alias("iterations"), F.lit(round(m.reconstruction_err, 6)).alias("reconstruction_err"))
    return EVP.mf_errors(run).select("model", fit.alias("fit"), r6("rmse"), r6("mae"), "n").select("model", "fit.*", "rmse", "mae", "n")


@q("f10_predictions")
def f10(spark, sf):
    return _mf(spark, sf).test_pred.select("model", "client_id", "merchant_id", r6("rating"), r6("prediction"))


@q("f11_rating_errors")
def f11(spark, sf):
    e = EVP.mf_errors(_mf(spark, sf))
    return e.select("model", r6("rmse"), r6("mae"), "n")


@q("d31_actual_vs_predicted")
def d31(spark, sf):
    p = _mf(spark, sf).test_pred
    return p.groupBy("model").agg(
        F.round(F.avg("rating"), 6).alias("actual_mean"), F.round(F.stddev_pop("rating"), 6).alias("actual_std"),
        F.round(F.avg("prediction"), 6).alias("predicted_mean"), F.round(F.stddev_pop("prediction"), 6).alias("predicted_std"),
    )


@q("f12_recommend_svd")
def f12(spark, sf):
    """Ten unrated places for every user, from a fit of all ratings."""
    r = _ratings(spark, sf)
    model = FA.fit_svd(r, k=20)
    info = merchant_info(base.tx(spark, sf))
    top = FA.recommend_factors(model, r.select("client_id", "merchant_id"), r.select("merchant_id"), n=10, info=info)
    return top.select("client_id", "rank", "merchant_id", r6("score"), "merchant_city", "merchant_state", "mcc_description")


@q("f12_products_formed")
def f12b(spark, sf):
    """The share of the full product that the search for the ten best forms."""
    r = _ratings(spark, sf)
    work = FA.recommend_factors(
        FA.fit_svd(r, k=20), r.select("client_id", "merchant_id"), r.select("merchant_id"), n=10, item_block=2_000, scored=True)
    return work.withColumn("share", F.round(F.col("scored") / F.col("dense"), 6))


@q("f13_factor_top_items")
def f13(spark, sf):
    run = _mf(spark, sf)
    info = merchant_info(base.tx(spark, sf))
    out = []
    for name in ("svd", "nmf"):
        t = FA.factor_top_items(run.models[name], 5, 5, info).withColumn("model", F.lit(name))
        out.append(t.select("model", "factor", "rank", "merchant_id", r6("weight"), "merchant_city", "merchant_state", "mcc_description"))
    return out[0].unionByName(out[1])


def _all_metrics(spark, sf):
    cf_long = EVP.cf_metrics(EVP.cf_run(base.cf(spark, sf)))[2]
    run = _mf(spark, sf)
    mf_rank = EV.ranking_metrics(run.eval.recs, run.eval.relevant, run.eval.users, models=run.eval.models)
    mf_cov = EV.coverage(run.eval.recs, run.eval.n_items, 10)
    mf_long = EV.metrics_long(mf_rank, mf_cov, EVP.mf_errors(run))
    return cf_long.unionByName(mf_long)


@q("g12_model_comparison_all")
def g12(spark, sf):
    return EV.compare_models(_all_metrics(spark, sf))


@q("g12_best_by_metric_all")
def g12b(spark, sf):
    return EV.best_by_metric(_all_metrics(spark, sf))


@q("g12_insights")
def g12c(spark, sf):
    """Fact rows: size of the data and error of each factor model."""
    size = IN.matrix_stats(base.ix(spark, sf)).select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("fact"), F.col(c).cast("double").alias("value")) for c in ("n_users", "n_items", "nnz", "sparsity")])).alias("f")
    ).select(F.lit(None).cast("string").alias("model"), "f.*")
    errors = EVP.mf_errors(_mf(spark, sf)).select(
        "model", F.explode(F.array(*[F.struct(F.lit(c).alias("fact"), F.round(c, 6).alias("value")) for c in ("rmse", "mae")])).alias("f")
    ).select("model", "f.*")
    return size.unionByName(errors)
