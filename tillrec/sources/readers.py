"""Scans (survey A1-A7, A13)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import CARD_COLUMNS, TX_COLUMNS, USER_COLUMNS


def _read_csv_by_name(spark: SparkSession, path: str, columns: dict[str, str], strict: bool = True) -> DataFrame:
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    present = set(raw.columns)
    cols: list[Column] = []
    for name, typ in columns.items():
        if name in present:
            c = F.col(f"`{name}`")
            cols.append((c.cast(typ) if strict else c.try_cast(typ)).alias(name))
        else:
            cols.append(F.lit(None).cast(typ).alias(name))
    return raw.select(*cols)


def read_transactions(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """A1: transactions CSV with header → canonical raw columns."""
    return _read_csv_by_name(spark, path, TX_COLUMNS, strict)


def read_users(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """A2."""
    return _read_csv_by_name(spark, path, USER_COLUMNS, strict)


def read_cards(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """A3."""
    return _read_csv_by_name(spark, path, CARD_COLUMNS, strict)


def read_code_map(spark: SparkSession, path: str) -> DataFrame:
    """A4: flat JSON object code → description, as a (mcc, mcc_description)
    dimension.  The file is small by nature (one object); it is read once and
    broadcast by the joins that use it."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("mcc", "mcc_description"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A5: ``{"target": {"<id>": "Yes"|"No", ...}}`` → (id, label).  The one
    JSON object is split at its commas, so many tasks read a large file."""
    parts = spark.read.option("lineSep", ",").text(path)
    pat = r'"(\d+)"\s*:\s*"(Yes|No)"'
    return (
        parts.where(F.col("value").rlike(pat))
        .select(
            F.regexp_extract("value", pat, 1).alias("id"),
            F.regexp_extract("value", pat, 2).alias("label"),
        )
    )


def read_all(spark: SparkSession, pattern: str) -> DataFrame:
    """Every CSV matching a glob, stacked by column name (headers may
    differ between files; missing columns become null).  Files are listed by
    the file system of the path, one job reads the header lines, and files
    with the same header are one scan."""
    lines = spark.read.text(pattern).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))
    numbered = lines.withColumn("m", F.monotonically_increasing_id()).where("b = 0")
    first = numbered.groupBy("f").agg(F.min_by("value", "m").alias("header"))
    files: dict[str, list[str]] = {}
    for r in first.orderBy("f").collect():  # one row per file
        files.setdefault(r["header"], []).append(r["f"])
    if not files:
        raise FileNotFoundError(pattern)
    frames = [spark.read.option("header", True).csv(same) for same in files.values()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def head_sample(df: DataFrame, n: int | None, order_cols: list[str] | None = None) -> DataFrame:
    """First-n-rows cap, opt-in only (default: the full table).  The
    order is explicit because a distributed table has no row order."""
    if n is None:
        return df
    return df.orderBy(*(order_cols or df.columns)).limit(n)


def read_evaluation_results(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation JSON back into long (model, model_name, metric, k,
    value) rows: either one object {model, model_name, ...} per line, as A11
    writes them, or one document keyed by model."""
    schema = (
        "model_name string, rmse double, mae double, coverage double, "
        "precision_at_k map<string,double>, recall_at_k map<string,double>, f1_at_k map<string,double>"
    )
    whole = F.from_json("value", f"map<string, struct<{schema}>>")
    keyed = spark.read.text(path, wholetext=True).select(F.explode(whole).alias("model", "r"))
    line = F.from_json("value", f"model string, {schema}")
    lines = spark.read.text(path).select(line.alias("r")).where("r.model is not null and r.model_name is not null")
    rows = lines.select("r.model", F.struct(*[F.col(f"r.{c.split()[0]}") for c in schema.split(", ")]).alias("r"))
    return from_results_map(keyed.where("r.model_name is not null").unionByName(rows))


def from_results_map(models: DataFrame) -> DataFrame:
    scalars = [
        F.struct(F.lit(m).alias("metric"), F.lit(None).cast("int").alias("k"), F.col(f"r.{m}").alias("value"))
        for m in ("rmse", "mae", "coverage")
    ]
    s = models.select("model", F.col("r.model_name").alias("model_name"), F.explode(F.array(*scalars)).alias("x"))
    s = s.select("model", "model_name", "x.*").where(F.col("value").isNotNull())
    out = [s]
    for m, name in (("precision_at_k", "precision"), ("recall_at_k", "recall"), ("f1_at_k", "f1")):
        e = models.select("model", F.col("r.model_name").alias("model_name"), F.explode(f"r.{m}").alias("k", "value"))
        out.append(e.select("model", "model_name", F.lit(name).alias("metric"), F.col("k").cast("int").alias("k"), "value"))
    return reduce(lambda a, b: a.unionByName(b), out)
