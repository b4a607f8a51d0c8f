"""Profiling (survey B1-B10).  Each profile is one aggregation pass whose
wide single row is unpivoted into a small long table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import reliable
from .common import exact_quantiles


def profile_schema(spark: SparkSession, df: DataFrame) -> DataFrame:
    """B1: (position, column_name, data_type)."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "position int, column_name string, data_type string")


def _unpivot_one_row(row_df: DataFrame, names: list[str], value_name: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(f"`{n}`").alias(value_name)) for n in names])
    return row_df.select(F.explode(pairs).alias("_p")).select("_p.*")


def null_counts(df: DataFrame) -> DataFrame:
    """B2: (column_name, n_null) in one pass."""
    agg = df.agg(*[F.sum(F.col(f"`{c}`").isNull().cast("bigint")).alias(c) for c in df.columns])
    return _unpivot_one_row(agg, df.columns, "n_null").withColumn("n_null", F.coalesce("n_null", F.lit(0)).cast("bigint"))


def top_null_columns(df: DataFrame, n: int = 10) -> DataFrame:
    """B3."""
    return null_counts(df).orderBy(F.col("n_null").desc(), F.col("column_name").asc()).limit(n)


def column_kinds(df: DataFrame) -> tuple[list[str], list[str]]:
    """Numeric vs categorical (string) column names."""
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    cat = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return num, cat


def observed(df: DataFrame) -> tuple[DataFrame, Observation]:
    """``df`` that counts its rows and nulls (B2, B6) while some later job
    runs over it, and the observation that has the counts afterwards."""
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("n_rows"), *[F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"null_{k}") for k, c in enumerate(df.columns)]]
    return df.observe(seen, *counts), seen


def observed_profile(spark: SparkSession, df: DataFrame, seen: Observation) -> DataFrame:
    """B1-B3 of an observed write: (position, column_name, data_type, n_rows, n_null)."""
    got = seen.get
    rows = [(k, f.name, f.dataType.simpleString(), got["n_rows"], got[f"null_{k}"]) for k, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "position int, column_name string, data_type string, n_rows bigint, n_null bigint")


STATS = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]


def describe_numeric(df: DataFrame, columns: list[str] | None = None, digits: int = 4) -> DataFrame:
    """Count, mean, sample std, min, exact interpolated quartiles, max
    per numeric column.  The numbers are written once, narrow; one
    aggregation of them gives the moments, and the quartiles come by
    selection."""
    cols = columns or column_kinds(df)[0]
    df = reliable(df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols]))
    aggs = []
    for c in cols:
        x = F.col(f"`{c}`")
        aggs += [
            F.count(x).alias(f"{c}__count"),
            F.avg(x).alias(f"{c}__mean"),
            F.stddev_samp(x).alias(f"{c}__std"),
            F.min(x).alias(f"{c}__min"),
            F.max(x).alias(f"{c}__max"),
        ]
    row = df.agg(*aggs)
    structs = []
    for c in cols:
        structs.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(f"`{c}__count`").alias("count"),
                F.round(F.col(f"`{c}__mean`"), digits).alias("mean"),
                F.round(F.col(f"`{c}__std`"), digits).alias("std"),
                F.col(f"`{c}__min`").alias("min"),
                F.col(f"`{c}__max`").alias("max"),
            )
        )
    stats = row.select(F.explode(F.array(*structs)).alias("_s")).select("_s.*")
    q = exact_quantiles(df, [0.25, 0.5, 0.75]).groupBy("column_name").agg(
        *[F.round(F.max(F.when(F.col("prob") == v, F.col("value"))), digits).alias(n) for n, v in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))]
    )
    return stats.join(q, "column_name", "left").select("column_name", *STATS)


def shape(df: DataFrame) -> DataFrame:
    """(n_rows, n_cols)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def preview(df: DataFrame, n: int = 5, order_cols: list[str] | None = None) -> DataFrame:
    """First n rows in an explicit order."""
    return df.orderBy(*(order_cols or df.columns)).limit(n)


def sample_rows(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Repeatable sample of n rows: the n smallest row hashes."""
    return df.withColumn("_h", F.xxhash64(*df.columns, F.lit(seed))).orderBy("_h").limit(n).drop("_h")


def drop_incomplete(df: DataFrame) -> DataFrame:
    """B9."""
    return df.na.drop("any")


def value_counts(df: DataFrame, col: str, count_name: str = "n") -> DataFrame:
    """Counts per non-null value, count desc then value asc."""
    return (
        df.where(F.col(col).isNotNull())
        .groupBy(col)
        .agg(F.count(F.lit(1)).alias(count_name))
        .orderBy(F.col(count_name).desc(), F.col(col).asc())
    )
