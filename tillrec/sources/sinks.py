"""Sinks (survey A8-A12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.evaluate import COMPARE_COLUMNS, compare_models
from ..operators.profile import observed, observed_profile
from ..operators.similarity import weighted_cells


def write_transactions(tx: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = "year") -> DataFrame:
    """Cleaned transactions, partitioned by year (partition pruning for
    date-bounded reads).  The same job counts rows and nulls; the result is
    their profile (B1-B3): column, type, rows, nulls."""
    counted, seen = observed(tx)
    w = counted.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
    return observed_profile(tx.sparkSession, tx, seen)


def write_cells(ix: DataFrame, name: str, key: str, other: str, value: str = "transaction_count", buckets: int = 64) -> None:
    """A10 as a bucketed table: the non-zero cells of the interactions with
    the norm of their key and the degree of their other side, hash-bucketed
    and sorted by the other side.  ``bucketed_cosine_pairs`` joins it with
    itself without an exchange; written once by item and once by user, it
    serves E1 and E2 for any number of runs."""
    cells = weighted_cells(ix, key, other, value)
    cells.write.mode("overwrite").bucketBy(buckets, "_x").sortBy("_x").saveAsTable(name)


def write_matrix(ix: DataFrame, path: str, row: str, col: str, value: str, values: list | None = None,
                 fmt: str = "parquet", max_cols: int = 10_000) -> None:
    """The user×item matrix.  Stored long (row, col, value) by default;
    ``fmt='csv'`` writes the wide 0-filled pivot, only for a bounded explicit
    column list (the reference's CSV matrix layout)."""
    if fmt != "csv":
        ix.select(row, col, value).write.mode("overwrite").parquet(path)
        return
    if values is None:
        raise ValueError("a wide matrix needs an explicit, bounded column list")
    if len(values) > max_cols:
        raise ValueError(f"{len(values)} columns exceed max_cols={max_cols}")
    wide = ix.groupBy(row).pivot(col, values).agg(F.sum(value)).na.fill(0)
    wide.write.mode("overwrite").option("header", True).csv(path)


def write_interactions(ix: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A10: long interaction tables."""
    w = ix.write.mode("overwrite")
    (w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path))


def write_evaluation_results(metrics: DataFrame, path: str, model_names: dict[str, str] | None = None) -> None:
    """One JSON object per model: {model, model_name, rmse?, mae?,
    precision_at_k{K}, recall_at_k{K}, f1_at_k{K}, coverage}; models without
    any metric are skipped.  K keys become strings, as in JSON."""
    names = model_names or {}
    name_map = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))]) if names else None
    by_k = metrics.where(F.col("k").isNotNull())
    maps = by_k.groupBy("model", "metric").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("k").cast("string"), F.col("value")))).alias("m")
    )
    wide_k = maps.groupBy("model").pivot("metric", ["precision", "recall", "f1"]).agg(F.first("m"))
    scal = metrics.where(F.col("k").isNull()).groupBy("model").pivot("metric", ["rmse", "mae", "coverage"]).agg(
        F.first("value")
    )
    out = wide_k.join(scal, "model", "full_outer").select(
        "model",
        (F.coalesce(name_map[F.col("model")], F.col("model")) if name_map is not None else F.col("model")).alias("model_name"),
        "rmse", "mae",
        F.col("precision").alias("precision_at_k"),
        F.col("recall").alias("recall_at_k"),
        F.col("f1").alias("f1_at_k"),
        "coverage",
    )
    out.coalesce(1).write.mode("overwrite").json(path)


def write_model_comparison(metrics: DataFrame, path: str) -> None:
    """Comparison CSV with fixed columns and 'N/A' for missing values."""
    cmp = compare_models(metrics, formatted=True)
    names = ["model"] + [m if k is None else f"{m}_{k}" for m, k in COMPARE_COLUMNS]
    cmp.select(*names).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
