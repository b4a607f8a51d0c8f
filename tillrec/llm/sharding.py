"""Byte-balanced sharding by global prefix sums.

Documents stand in one global order, (md5 of the text, md5 of the id), and
every shard is a contiguous run of it.  A document's place is the bytes
before it: bytes of all earlier cells, from per-cell totals, plus a running
sum inside its own cell.  Cells are ranges of the digest sized from the row
count; a cell that one text overfills is cut further by the text and the id's
digest, so a third of all rows with one text still means many small cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillrec.llm.common import before_cells, col, free_columns, hex_bucket, reliable

OUT = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def _keyed(docs: DataFrame, keep: list[str], id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(col(text_col), F.lit(""))
    return docs.select(
        *[col(c) for c in keep],
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.md5(F.encode(text, "UTF-8")).alias("__a"),
        F.md5(F.coalesce(col(id_col).cast("string"), F.lit("")).cast("binary")).alias("__b"),
    )


def shard_by_bytes(
    docs: DataFrame,
    n_shards: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: bool = False,
    rows_per_cell: int = 4096,
) -> DataFrame:
    """One row per document: id, ``size`` (UTF-8 bytes + 1), ``text_crc32``,
    ``law`` = 'bytes', ``shard`` (0 .. n_shards-1), ``slot`` (0, 1, ... within
    the shard) and ``grown_shard`` = null.  With ``carry`` all columns of
    ``docs`` are kept, and those whose names clash with the new ones go.

    A document belongs to the shard that holds the middle of its bytes, so
    each cut is off its equal target by at most half a document.  Null text
    counts as empty (size 1, checksum 0); null ids sort as empty text; rows
    that are equal in id and text are interchangeable and all kept; an empty
    table gives an empty result.
    """
    keep = free_columns(docs, OUT) if carry else [id_col]
    narrow = reliable(_keyed(docs, [], id_col, text_col).drop("text_crc32") if carry else _keyed(docs, keep, id_col, text_col))
    n, total = narrow.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    cells1 = max(1, -(-n // rows_per_cell))
    first: Column = hex_bucket(F.col("__a"), F.lit(cells1))

    # cells that hold far more than their share are cut by text and id
    crowded = (
        narrow.groupBy(first.alias("__c1"))
        .agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") > 4 * rows_per_cell)
        .select("__c1", F.ceil(F.col("__n") / rows_per_cell).cast("bigint").alias("__m"))
    )

    def celled(rows: DataFrame) -> DataFrame:
        split = F.col("__m").isNotNull()
        return (
            rows.withColumn("__c1", first)
            .join(crowded, "__c1", "left")
            .withColumn("__c2", F.when(split, F.col("__a")).otherwise(F.lit("")))
            .withColumn("__c3", F.when(split, hex_bucket(F.col("__b"), F.col("__m"))).otherwise(F.lit(0)))
            .drop("__m")
        )

    key = ["__c1", "__c2", "__c3"]
    cells = celled(narrow).groupBy(*key).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    heads = before_cells(cells, key, ["bytes", "rows"], [], F.floor(F.col("__c1") / 1024))

    def placed(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy(*key).orderBy("__a", "__b", "size").rowsBetween(Window.unboundedPreceding, 0)
        start = F.col("bytes_before") + F.sum("size").over(w) - F.col("size")
        middle = start * 2 + F.col("size")
        return (
            celled(rows)
            .join(heads, key)
            .withColumn("shard", F.least(F.floor(middle * n_shards / F.lit(max(1, 2 * total))), F.lit(n_shards - 1)).cast("int"))
            .withColumn("__rank", F.col("rows_before") + F.row_number().over(Window.partitionBy(*key).orderBy("__a", "__b", "size")) - 1)
        )

    starts = placed(narrow).groupBy("shard").agg(F.min("__rank").alias("__start"))  # n_shards rows at most
    rows = _keyed(docs, keep, id_col, text_col) if carry else narrow
    return (
        placed(rows)
        .join(F.broadcast(starts), "shard")
        .select(
            *[col(c) for c in keep],
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("__rank") - F.col("__start")).cast("bigint").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
