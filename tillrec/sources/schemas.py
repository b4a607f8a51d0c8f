"""Canonical column sets of the engine (survey 1.2).

Text files are read with every column as string (no inference pass) and then
cast by *name*, so column order and extra columns in a file do not matter.
"""

from __future__ import annotations

# canonical raw transaction columns and the type each one is cast to
TX_COLUMNS: dict[str, str] = {
    "id": "bigint",
    "date": "string",  # parsed by the cleaning step (C1)
    "client_id": "bigint",
    "amount": "string",  # money text, parsed by the cleaning step (C2)
    "merchant_id": "bigint",
    "merchant_city": "string",
    "merchant_state": "string",
    "mcc": "int",
}

USER_COLUMNS: dict[str, str] = {
    "id": "bigint",
    "current_age": "int",
    "yearly_income": "string",
    "total_debt": "string",
    "credit_score": "int",
}

CARD_COLUMNS: dict[str, str] = {
    "id": "bigint",
    "client_id": "bigint",
    "card_type": "string",
    "credit_limit": "string",
}

# cleaned transactions: raw columns plus derived ones, in output order
CLEAN_COLUMNS = [
    "id", "date", "client_id", "amount", "merchant_id", "merchant_city", "merchant_state", "mcc",
    "is_fraud", "mcc_description", "year", "month", "day", "hour", "day_of_week", "amount_category",
]
