import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"

# micro-fixture of FIXTURES.md §3.1 (raw, reference-shaped text columns)
MICRO_TX = [
    (1, "2010-01-01 00:01:00", 10, "$10.00", 100, "Austin", "TX", 5411),
    (2, "2010-01-01 09:30:00", 10, "$1,234.56", 101, "Dallas", "TX", 5812),
    (3, "2010-01-02 12:00:00", 10, "$20.00", 100, "Austin", "TX", 5411),
    (4, "2010-01-03 13:15:00", 20, "$-77.00", 100, "Austin", "TX", 5411),
    (5, "2010-01-04 08:00:00", 20, "$50.00", 102, "ONLINE", None, 4829),
    (6, "2010-02-04 08:00:00", 20, "$0.00", 101, "Dallas", "TX", 5812),
    (7, "2010-02-05 23:59:59", 30, "$500.00", 102, "ONLINE", None, 4829),
    (8, "2010-02-05 10:00:00", 30, "$100.01", 103, "Miami", "FL", 9999),
    (9, "2010-03-01 11:00:00", 40, "$5.50", 103, "Miami", "FL", 9999),
    (10, "2010-03-02 11:00:00", 40, "$30.00", 103, "Miami", "FL", 9999),
    (11, "2010-03-03 11:00:00", 40, "$12.00", 104, "Reno", "NV", 5541),
]
MICRO_SCHEMA = (
    "id bigint, date string, client_id bigint, amount string, merchant_id bigint, "
    "merchant_city string, merchant_state string, mcc int"
)
MICRO_LABELS = {"1": "No", "2": "Yes", "3": "No", "5": "No", "7": "Yes"}
MICRO_CODES = {
    "5411": "Grocery Stores, Supermarkets",
    "5812": "Eating Places and Restaurants",
    "4829": "Money Transfer",
    "5541": "Service Stations",
}


@pytest.fixture(scope="session")
def spark():
    from tillrec.session import local_session

    s = local_session("*", 8, app="tillrec-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def micro_raw(spark):
    return spark.createDataFrame(MICRO_TX, MICRO_SCHEMA)


@pytest.fixture(scope="session")
def micro_tx(spark, micro_raw):
    from tillrec.operators.clean import clean_transactions

    labels = spark.createDataFrame(list(MICRO_LABELS.items()), "id string, label string")
    codes = spark.createDataFrame(list(MICRO_CODES.items()), "mcc string, mcc_description string")
    return clean_transactions(micro_raw, labels, codes).cache()


@pytest.fixture(scope="session")
def micro_ix(micro_tx):
    from tillrec.operators.interactions import interactions

    return interactions(micro_tx).cache()
