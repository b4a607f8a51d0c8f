"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillrec.session import ensure_checkpoint_dir


def reliable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder of the session and read it
    from there: lineage is cut and a lost executor loses nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same as a Parquet table in a folder of its own there: columnar and
    compressed, for wide or numerous rows that are read more than once."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_columns(df: DataFrame, taken: list[str]) -> list[str]:
    """Columns of ``df`` whose names do not clash with ``taken`` (case-insensitively)."""
    low = {c.lower() for c in taken}
    return [c for c in df.columns if c.lower() not in low]


def col(name: str) -> Column:
    """A column by its literal name (dots are part of the name)."""
    return F.col("`" + name.replace("`", "``") + "`")


def before_cells(cells: DataFrame, order: list[str], sums: list[str], within: list[str], group: Column) -> DataFrame:
    """Exclusive prefix sums ``<s>_before`` of every column of ``sums`` over the
    rows of ``cells`` in the total order ``within + order``.

    Two levels: totals per ``group`` (a monotone function of the first order
    column, about a thousand cells each) are summed first, then each group is
    summed by itself, so no task holds more than the group table or a group.
    ``within`` starts the sums anew for each of its values."""
    cells = cells.withColumn("__g", group)
    totals = cells.groupBy(*within, "__g").agg(*[F.sum(s).alias(f"__t_{s}") for s in sums])
    wg = Window.partitionBy(*within).orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)
    heads = totals.select(*within, "__g", *[F.coalesce(F.sum(f"__t_{s}").over(wg), F.lit(0)).alias(f"__h_{s}") for s in sums])
    wc = Window.partitionBy(*within, "__g").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = cells.select("*", *[F.coalesce(F.sum(s).over(wc), F.lit(0)).alias(f"__i_{s}") for s in sums])
    joined = inner.join(heads, [*within, "__g"])
    return joined.select(
        *within, *order, *[(F.col(f"__h_{s}") + F.col(f"__i_{s}")).alias(f"{s}_before") for s in sums]
    )


def hex_bucket(hex_col: Column, buckets: Column) -> Column:
    """Monotone bucket 0 .. buckets-1 of a hex digest by its first eight digits."""
    return F.floor(F.conv(F.substring(hex_col, 1, 8), 16, 10).cast("double") * buckets / F.lit(4294967296.0)).cast("bigint")


FLUSH_BYTES = 8 << 20


def map_rows(df: DataFrame, make, schema: str, weigh=None) -> DataFrame:
    """``mapInArrow`` over lists of rows: ``make()`` gives, once per task, a
    function (row tuple) -> output tuple.  Output is flushed every
    ``FLUSH_BYTES`` of what ``weigh(output tuple)`` counts (or 4096 rows), so
    long texts never gather in one batch."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow: pa.Schema = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        one = make()
        out, held = [], 0

        def flush():
            cols = list(zip(*out)) if out else [()] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow)], schema=arrow)

        for batch in batches:
            columns = batch.columns
            for i in range(batch.num_rows):
                row = one(*[c[i].as_py() for c in columns])
                out.append(row)
                held += weigh(row) if weigh else 0
                if held >= FLUSH_BYTES or len(out) >= 4096:
                    yield flush()
                    out, held = [], 0
        if out:
            yield flush()

    return df.mapInArrow(run, schema)
