"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a shuffled order (md5 of seed, id and text),
``max_epochs`` times over.  A copy's virtual finish time is the words of its
source up to and including it, divided by the source's weight.  All copies
are range-sorted by finish time and cut where their running size reaches the
budget: at any virtual time each source has been served in proportion to its
weight, and one that runs dry leaves its share to the others by weight.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillrec.llm.common import before_cells, col, free_columns, hex_bucket, reliable

WORD = r"[^\x20\x09-\x0D]+"
OUT = ["size", "source_size", "target", "taken"]


def _sized(docs: DataFrame, keep: list[str], id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    text = col(text_col)
    tag = F.concat(F.lit(f"{seed}:"), F.coalesce(col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return docs.select(
        *[col(c) for c in keep],
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        col(source_col).cast("string").alias("__s"),
        F.md5(F.encode(tag, "UTF-8")).alias("__h"),
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, max_epochs: int) -> DataFrame:
    """Per source of ``sizes`` (__s, __rows, source_size): its rank by code
    point (null last), weight, and target.  Targets are weight x V, stopped
    at ``max_epochs`` x the source's size, with V such that they sum to
    ``share`` of all sizes: a source is stopped if the targets at its own
    stopping point do not exceed the budget."""
    rank = F.row_number().over(Window.orderBy(F.col("__s").asc_nulls_last())) - 1
    every = Window.partitionBy()
    by_stop = Window.orderBy("__stop", "__rank").rowsBetween(Window.unboundedPreceding, 0)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    return (
        sizes.withColumn("__rank", rank)
        .withColumn("__w", weight)
        .withColumn("__cap", F.col("source_size") * float(max_epochs))
        .withColumn("__stop", F.col("__cap") / F.col("__w"))
        .withColumn("__budget", F.sum("source_size").over(every) * share)
        .withColumn("__served", F.sum("__cap").over(by_stop) + F.col("__stop") * (F.sum("__w").over(every) - F.sum("__w").over(by_stop)))
        .withColumn("__full", F.col("__served") <= F.col("__budget"))
        .withColumn("__left", F.col("__budget") - F.sum(F.when(F.col("__full"), F.col("__cap")).otherwise(0.0)).over(every))
        .withColumn("__open", F.sum(F.when(F.col("__full"), 0.0).otherwise(F.col("__w"))).over(every))
        .withColumn("target", F.when(F.col("__full"), F.col("__cap")).otherwise(F.col("__w") * F.col("__left") / F.col("__open")))
        .select("__s", "__rank", "__w", "__rows", "source_size", "target", "__budget")
    )


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 42,
    carry: bool = False,
    rows_per_cell: int = 4096,
    rows_per_range: int = 1 << 20,
) -> DataFrame:
    """One row per document: id, ``size`` (words), ``source_size`` (words of
    its source), ``target`` (words its source is to give), ``taken`` (words
    the mix takes of it, repeats counted; a multiple of ``size``).  With
    ``carry`` all columns of ``docs`` stay (those that clash with the new
    names go), and ``taken`` / ``size`` says how often a row is used.

    Whole documents are taken, so a source is off its target by less than its
    longest document and its share of the others' remainders.  Null text has
    size 0; null sources form one source, ranked last; equal rows are
    interchangeable and all kept; empty documents are never taken; an empty
    table gives an empty result.  The order rests on digests alone, so
    reruns agree.
    """
    keep = free_columns(docs, OUT) if carry else [id_col]
    rows = _sized(docs, keep, id_col, text_col, source_col, seed)
    narrow = reliable(_sized(docs, [] if carry else keep, id_col, text_col, source_col, seed))
    sizes = narrow.groupBy("__s").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("__rows"))
    sources = reliable(source_targets(sizes, weights, share, max_epochs))

    def celled(df: DataFrame) -> DataFrame:
        parts = F.ceil(F.col("__rows") / rows_per_cell).cast("bigint")
        small = F.broadcast(sources) if few else sources
        return df.join(small, df["__s"].eqNullSafe(small["__s"])).drop("__s").withColumn("__c", hex_bucket(F.col("__h"), parts))

    few = sources.count() <= 10_000  # some 100 bytes a row: a megabyte at most
    cells = celled(narrow).groupBy("__rank", "__c").agg(F.sum("size").alias("words"))
    heads = before_cells(cells, ["__c"], ["words"], ["__rank"], F.floor(F.col("__c") / 1024))

    def queued(df: DataFrame) -> DataFrame:
        w = Window.partitionBy("__rank", "__c").orderBy("__h", "size").rowsBetween(Window.unboundedPreceding, 0)
        return (
            celled(df)
            .join(heads, ["__rank", "__c"])
            .withColumn("__end", F.col("words_before") + F.sum("size").over(w))
        )

    def finish(epoch):
        return (epoch * F.col("source_size") + F.col("__end")) / F.col("__w")

    # one row per copy, globally range-sorted; partition totals place the cut
    copies = (
        queued(narrow)
        .where(F.col("size") > 0)
        .select("size", "__rank", "__budget", "__h", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("__e"), "source_size", "__end", "__w")
        .select(finish(F.col("__e")).alias("__v"), "__rank", "__e", "__h", "size", "__budget")
    )
    order = ["__v", "__rank", "__e", "__h"]
    n = narrow.count()
    ranged = reliable(copies.repartitionByRange(max(1, -(-n * max_epochs // rows_per_range)), *order).withColumn("__p", F.spark_partition_id()))
    totals = ranged.groupBy("__p").agg(F.sum("size").alias("__t"), F.max("__budget").alias("__budget"))
    upto = totals.withColumn("__upto", F.sum("__t").over(Window.orderBy("__p")))
    last = upto.where(F.col("__upto") > F.col("__budget")).orderBy("__p").limit(1)
    w = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    over = (
        ranged.join(F.broadcast(last.select("__p", (F.col("__upto") - F.col("__t")).alias("__pre"))), "__p")
        .withColumn("__run", F.col("__pre") + F.sum("size").over(w))
        .where(F.col("__run") > F.col("__budget"))
        .orderBy(*order)
        .select(*order)
        .first()
    )

    def used(epoch: int):
        if over is None:  # nothing lies beyond the budget
            return F.lit(1)
        key = F.struct(finish(F.lit(epoch)).alias("v"), F.col("__rank").alias("r"), F.lit(epoch).alias("e"), F.col("__h").alias("h"))
        cut = F.struct(F.lit(over["__v"]).alias("v"), F.lit(over["__rank"]).alias("r"), F.lit(over["__e"]).alias("e"), F.lit(over["__h"]).alias("h"))
        return (key < cut).cast("int")

    times = sum((used(e) for e in range(1, max_epochs)), used(0))
    out = queued(rows if carry else narrow).withColumn("taken", (F.col("size") * times).cast("bigint"))
    return out.select(*[col(c) for c in keep], "size", "source_size", F.col("target").cast("double").alias("target"), "taken")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the mix takes it, with
    all its columns, also those that bear a name of the mix's own."""
    names = {c.lower(): f"__d{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[col(c).alias(names[c.lower()]) for c in docs.columns])
    asked = {k: names[c.lower()] for k, c in (("id_col", id_col), ("text_col", text_col), ("source_col", source_col))}
    out = mix_sources(plain, carry=True, **asked, **options)
    times = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    return (
        out.withColumn("__times", times)
        .where(F.col("__times") > 0)
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times"))))
        .select(*[col(names[c.lower()]).alias(c) for c in docs.columns])
    )
