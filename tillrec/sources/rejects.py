"""Checked scans: a malformed record goes to a reject table with its reasons
instead of failing the job or turning into nulls (survey C1, A1-A3).

Every record of the file is in exactly one of two tables: ``accepted`` (typed
by name, ready for the cleaning step) or ``rejected`` (the record as text, its
file and the reasons).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import parse_money, parse_timestamp
from .schemas import CARD_COLUMNS, TX_COLUMNS, USER_COLUMNS

CORRUPT = "_corrupt_record"


@dataclass(frozen=True)
class Checks:
    """What a file's columns must be: canonical types, and which text columns
    hold a date or an amount of money; ``required`` ones may not be empty."""

    columns: dict[str, str]
    dates: tuple[str, ...] = ()
    money: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    date_format: str | None = field(default=None)


TRANSACTIONS = Checks(TX_COLUMNS, dates=("date",), money=("amount",), required=("id",))
USERS = Checks(USER_COLUMNS, money=("yearly_income", "total_debt"), required=("id",))
CARDS = Checks(CARD_COLUMNS, money=("credit_limit",), required=("id",))


def _reasons(present: set[str], checks: Checks) -> Column:
    """The faults of a record as an array of text, empty for a good one."""
    out = [F.when(F.col(CORRUPT).isNotNull(), F.lit("wrong number of fields"))]
    for name, kind in checks.columns.items():
        if name not in present:
            continue
        c = F.trim(F.col(f"`{name}`"))
        full = c.isNotNull() & (c != "")
        if name in checks.required:
            out.append(F.when(~F.coalesce(full, F.lit(False)), F.lit(f"{name}: missing")))
        if name in checks.dates:
            out.append(F.when(full & parse_timestamp(c, checks.date_format, lenient=True).isNull(), F.lit(f"{name}: not a date")))
        elif name in checks.money:
            out.append(F.when(full & parse_money(c, lenient=True).isNull(), F.lit(f"{name}: not an amount")))
        elif kind != "string":
            out.append(F.when(full & c.try_cast(kind).isNull(), F.lit(f"{name}: not {kind}")))
    return F.array_compact(F.array(*out))


def read_checked(spark: SparkSession, path: str, checks: Checks = TRANSACTIONS) -> DataFrame:
    """The records of CSV files with a header: canonical columns, typed (null
    where they fail), ``_record``, ``_file`` and ``_reasons``."""
    names = spark.read.option("header", True).csv(path).columns
    schema = ", ".join(f"`{c}` string" for c in [*names, CORRUPT])
    raw = (
        spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT).option("enforceSchema", False).csv(path)
    )
    present = set(names)
    typed = [
        (F.trim(F.col(f"`{c}`")).try_cast(t) if t != "string" else F.col(f"`{c}`")).alias(c) if c in present
        else F.lit(None).cast(t).alias(c)
        for c, t in checks.columns.items()
    ]
    own = F.struct(*[F.col(f"`{c}`") for c in names])
    record = F.coalesce(F.col(CORRUPT), F.to_csv(own))
    return raw.select(
        *typed, record.alias("_record"), F.col("_metadata.file_path").alias("_file"), _reasons(present, checks).alias("_reasons"))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("_reasons") == 0).drop("_record", "_file", "_reasons")


def rejected(checked: DataFrame) -> DataFrame:
    """(file, record, reasons) of the records that are not accepted."""
    return checked.where(F.size("_reasons") > 0).select(
        F.col("_file").alias("file"), F.col("_record").alias("record"), F.col("_reasons").alias("reasons"))


def write_checked(checked: DataFrame, clean_path: str, reject_path: str, clean=None) -> dict[str, int]:
    """Write both tables (``clean`` may transform the accepted one) and return
    the rows of each; the counts are observed while writing."""
    counts: dict[str, int] = {}
    for name, df, path in (("clean", accepted(checked), clean_path), ("rejected", rejected(checked), reject_path)):
        seen = Observation()
        counted = df.observe(seen, F.count(F.lit(1)).alias("n"))
        (clean(counted) if clean and name == "clean" else counted).write.mode("overwrite").parquet(path)
        counts[name] = seen.get["n"]
    return counts
