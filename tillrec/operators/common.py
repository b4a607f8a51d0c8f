"""Shared building blocks: checked broadcast, per-group top-N, global ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable

# Largest side (bytes, by the optimizer's estimate) that ``checked_broadcast`` ships to every executor.
BROADCAST_MAX_BYTES = 64 * 1024 * 1024


def checked_broadcast(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast ``df`` only if the optimizer's size estimate, an upper bound
    for projections and filters of files, is small; no job is run.  Otherwise
    the planner and adaptive execution decide from measured sizes."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= max_bytes else df


def top_n_per_group(
    df: DataFrame,
    group_cols: list[str],
    order_cols: list[Column],
    n: int,
    rank_col: str = "rank",
) -> DataFrame:
    """The first ``n`` rows of each group by a total order.

    ``row_number() <= n`` is planned as WindowGroupLimit: a partial top-n runs
    before the shuffle, so a hot group arrives at its reducer as at most
    n rows per map partition, never as the whole group."""
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def heavy_keys(df: DataFrame, key: str, limit: int) -> DataFrame:
    """Keys with more than ``limit`` rows and how many parts of that size they
    make: at most rows / limit keys.  The list grows with the rows, so it is
    joined without a hint: adaptive execution broadcasts it if its measured
    size allows and splits a hot key of the other side otherwise."""
    return (
        df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
        .select(key, F.ceil(F.col("_n") / F.lit(limit)).cast("int").alias("_parts"))
    )


def salted_join(left: DataFrame, right: DataFrame, key: str, limit: int = 100_000) -> DataFrame:
    """Inner join on ``key`` in which a key with more than ``limit`` rows on the
    left is cut into parts of that size, each meeting a copy of its right rows."""
    heavy = heavy_keys(left, key, limit)
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    a = left.join(heavy, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*left.columns), parts).cast("int")).drop("_parts")
    b = right.join(heavy, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return a.join(b, [key, "_salt"]).drop("_salt")


def _ranged(df: DataFrame, order: list[Column], weight: Column) -> DataFrame:
    """``df`` range-partitioned and written in that form, with its partition
    ``_p`` and ``_before``, the weight of all earlier partitions.  Only one
    number per partition meets in a single task."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = reliable(df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_p").agg(F.sum(weight).alias("_t"))
    before = totals.select("_p", F.coalesce(F.sum("_t").over(w), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(before), "_p")  # one row per partition


def ordered_rank(
    df: DataFrame, level_col: str, id_col: str, rank_col: str = "rank", level_desc: bool = True
) -> DataFrame:
    """Exact 1-based rank of every row by (level desc|asc, id asc) without a
    single-partition window, for ids of any orderable type.

    ``id_col`` must be unique.  Rows are range-partitioned by (level, id), so
    a level that holds most rows spreads over many partitions; a rank is the
    rows of earlier partitions plus the position inside its own."""
    order = [F.col(level_col).desc() if level_desc else F.col(level_col).asc(), F.col(id_col).asc()]
    ranged = _ranged(df, order, F.lit(1))
    pos = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ranged.withColumn(rank_col, (F.col("_before") + pos).cast("bigint")).drop("_p", "_before")


HISTOGRAM_BINS = 1024


def _order_statistics(numbers: DataFrame, asked: dict[str, set[int]], bins: int) -> dict[tuple[str, int], float]:
    """The values at 0-based ranks ``asked`` of each (double) column's numbers,
    by selection: every scan counts, for all columns at once, the values of
    each open range in ``bins`` equal parts; a rank goes on into the part
    that holds it, from the smallest to the largest value met there, until
    these are one value.  The ends of a range never share a part, so each
    scan narrows it.  Only parts that hold something, with their count and
    ends, come to the driver: at most ``bins`` for a range."""
    x = lambda c: F.col(f"`{c}`")
    ends = numbers.agg(*[f(x(c)) for c in asked for f in (F.min, F.max)]).first()
    found: dict[tuple[str, int], float] = {}
    todo = {(c, r): (float(ends[2 * k]), float(ends[2 * k + 1]), 0) for k, c in enumerate(asked) for r in asked[c]}
    while todo:
        found |= {key: lo for key, (lo, hi, _) in todo.items() if lo == hi}
        todo = {key: t for key, t in todo.items() if key not in found}
        if not todo:
            break
        ranges = sorted({(c, lo, hi) for (c, _), (lo, hi, _) in todo.items()})
        cells = []
        for k, (c, lo, hi) in enumerate(ranges):
            part = F.floor((x(c) / 2 - F.lit(lo / 2)) / F.lit(hi / 2 - lo / 2) * F.lit(float(bins)))
            part = F.when(x(c) == F.lit(hi), F.lit(bins - 1)).otherwise(F.least(part, F.lit(bins - 1 if bins == 1 else bins - 2)))
            cells.append(F.when((x(c) >= F.lit(lo)) & (x(c) <= F.lit(hi)), F.struct(F.lit(k).alias("k"), part.cast("int").alias("part"), x(c).alias("x"))))
        hist = numbers.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).select("c.*")
        hist = hist.groupBy("k", "part").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        parts: dict[int, list] = {}
        for r in sorted(hist.collect(), key=lambda r: (r["k"], r["part"])):
            parts.setdefault(r["k"], []).append(r)
        at = {key: k for k, key in enumerate(ranges)}
        for (c, rank), (lo, hi, before) in list(todo.items()):
            for r in parts[at[c, lo, hi]]:
                if rank < before + r["n"]:
                    todo[c, rank] = (r["lo"], r["hi"], before)
                    break
                before += r["n"]
    return found


def exact_quantiles(numbers: DataFrame, probs: list[float], bins: int = HISTOGRAM_BINS) -> DataFrame:
    """(column_name, prob, value): interpolated quantiles of the numbers of
    each (double) column of ``numbers``; null and NaN are no numbers, and a
    column without any has no rows.  No value is sorted or shuffled: see
    ``_order_statistics``; ``numbers`` is scanned a few times, so it should
    be a written table."""
    clean = numbers.select(*[F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")).alias(c) for c in numbers.columns])
    sizes = clean.agg(*[F.count(f"`{c}`") for c in clean.columns]).first()
    wanted, asked = [], {}
    for c, n in zip(clean.columns, sizes):
        for q in probs if n else []:
            at = (n - 1) * q
            lo = int(at)
            hi = lo + (at > lo)
            wanted.append((c, q, lo, hi, at - lo))
            asked.setdefault(c, set()).update((lo, hi))
    value = _order_statistics(clean, asked, bins) if asked else {}
    rows = [(c, float(q), value[c, lo] + (value[c, hi] - value[c, lo]) * part) for c, q, lo, hi, part in wanted]
    return numbers.sparkSession.createDataFrame(rows, "column_name string, prob double, value double")
