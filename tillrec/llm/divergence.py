"""Divergence between the sources of a language, over collapsed texts.

Equal texts of a language are one text with a number of copies per source.
Each such text is split into words once; its counts and its document, times
the copies, are added to every source that holds it.  The words kept in a
language are those in enough of its documents.

A source gives every kept word of its language a smoothed probability in
integer arithmetic, so all words count in a pair of sources.  Most words are
in few sources, and an absent word has one probability per source.  A pair's
sum is therefore put together from

* the words that neither holds (their number times one value),
* the words that one of them holds, through how many words it has at each
  probability, and
* a correction for the words that both hold, the only ones joined by word.
"""

from __future__ import annotations

from collections import _count_elements, defaultdict
from itertools import repeat

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillrec.llm.common import col, reliable, written

#: Bytes that make words: ASCII letters (lower-cased) and all bytes of other characters; the rest become spaces.
LETTERS = bytes(
    b | 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
#: Counters of a task hold at most about this many entries before they are sent on.
ENTRIES = 1_000_000
#: Sources of one text that travel together, and sources in a block of pairs.
LIST = 1024
BLOCK = 64
SCALE = 1_000_000_000


def collapsed(docs: DataFrame, text_col: str, lang_col: str, source_col: str, list_size: int = LIST) -> DataFrame:
    """(``lang``, ``text``, ``held``): each text of a language with its copies
    per source, an array of (source, n).  A text in more than ``list_size``
    sources comes in several rows with different sources."""
    text = F.coalesce(col(text_col), F.lit(""))
    keyed = docs.select(
        F.coalesce(col(lang_col).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(col(source_col).cast("string"), F.lit("")).alias("source"),
        F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("h"),
        text.alias("text"),
    )
    copies = keyed.groupBy("lang", "h", "source").agg(F.count(F.lit(1)).alias("n"))
    wide = (
        copies.groupBy("lang", "h").agg(F.ceil(F.count(F.lit(1)) / list_size).alias("parts")).where(F.col("parts") > 1)
    )
    part = F.pmod(F.xxhash64("source"), F.coalesce(F.col("parts"), F.lit(1)))
    held = (
        copies.join(wide, ["lang", "h"], "left")
        .groupBy("lang", "h", part.alias("part"))
        .agg(F.collect_list(F.struct("source", "n")).alias("held"))
        .drop("part")
    )
    texts = keyed.groupBy("lang", "h").agg(F.first("text").alias("text"))
    return texts.join(held, ["lang", "h"]).select("lang", F.col("text").cast("binary").alias("text"), "held")


def word_counts(collapsed_texts: DataFrame, entries: int = ENTRIES) -> DataFrame:
    """(``lang``, ``source``, ``term``, ``n``, ``docs``): occurrences of a word
    in a source and the documents that hold it.  A task adds up what it has
    read and sends it on whenever ``entries`` counters are full.  It keeps the
    occurrences, and what of them are repeats inside a document."""
    import pyarrow as pa

    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def count(batches):
        counts, repeats = defaultdict(dict), defaultdict(dict)

        def full():
            for (lang, source), have in counts.items():
                terms, again = list(have), repeats[lang, source].get
                for k in range(0, len(terms), 100_000):
                    some = terms[k : k + 100_000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(repeat(lang, len(some)), pa.string(), size=len(some)),
                            pa.array(repeat(source, len(some)), pa.string(), size=len(some)),
                            pa.array(some, pa.binary()).cast(pa.string()),
                            pa.array([have[t] for t in some], pa.int64()),
                            pa.array([have[t] - again(t, 0) for t in some], pa.int64()),
                        ],
                        schema=schema,
                    )
            counts.clear()
            repeats.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                words = batch.column(1)[i].as_py().translate(LETTERS).split()
                lang, held = batch.column(0)[i].as_py(), batch.column(2)[i].as_py()
                once: dict[bytes, int] = {}
                _count_elements(once, words)
                more = [(t, c) for t, c in once.items() if c > 1]
                for h in held:
                    key, n = (lang, h["source"]), h["n"]
                    have, again = counts[key], repeats[key]
                    if n == 1:
                        _count_elements(have, words)
                    else:
                        for t, c in once.items():
                            have[t] = have.get(t, 0) + c * n
                    for t, c in more:
                        again[t] = again.get(t, 0) + (c - 1) * n
                    if sum(map(len, counts.values())) > entries:
                        yield from full()
        yield from full()

    return collapsed_texts.mapInArrow(count, "lang string, source string, term string, n bigint, docs bigint")


def probability(n: str, total: str, words: str) -> Column:
    """1 + floor(10^9 (n + 1) / (total + words)) in long arithmetic, exact up
    to 2.8e14 words: the scale is applied in two steps, 31250 x 32000."""
    d = f"({total} + {words})"
    first = f"(({n} + 1) * 31250)"
    return F.when(
        F.expr(f"{d} > 0"), F.expr(f"1 + 32000 * ({first} div {d}) + (32000 * ({first} % {d})) div {d}")
    ).otherwise(F.lit(1).cast("bigint"))


def gap(p: str, q: str) -> str:
    """floor((p - q)^2 / q); p and q are at most 10^9 + 1."""
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def source_divergence(
    docs: DataFrame,
    min_docs: int = 3,
    top: int = 200,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    list_size: int = LIST,
    block: int = BLOCK,
    entries: int = ENTRIES,
) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``.

    Part ``pair``: item is every other source of the language, value the sum
    of floor((p - q)^2 / q) over the kept words, p the source's probability
    and q the item's.  Part ``term``: the first ``top`` kept words of the
    source whose p exceeds the language's q, value the same term.  Ranks go
    by falling value, then item.

    Null text, language or source counts as ''.  A source without words still
    has its pairs; a language with one source has no pairs; a language
    without kept words gives pairs of value 0.  Equal rows count as often as
    they stand there; an empty table gives an empty result; further columns
    are not read.
    """
    as_text = lambda c: F.coalesce(col(c).cast("string"), F.lit(""))
    texts = collapsed(docs, text_col, lang_col, source_col, list_size)
    counts = word_counts(texts, entries).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    every = docs.select(as_text(lang_col).alias("lang"), as_text(source_col).alias("source")).distinct()
    blocks = every.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    of_term = Window.partitionBy("lang", "term")
    cells = written(
        counts.withColumn("in_docs", F.sum("docs").over(of_term))
        .where(F.col("in_docs") >= min_docs)
        .select(
            "lang", "source", "term", "n",
            F.sum("n").over(of_term).alias("n_lang"),
            (F.row_number().over(of_term.orderBy("source")) == 1).alias("head"),
        )
    )
    sources = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("held"))
    langs = cells.where("head").groupBy("lang").agg(F.sum("n_lang").alias("total_lang"), F.count(F.lit(1)).alias("words"))
    zero = F.lit(0).cast("bigint")
    groups = reliable(
        every.join(sources, ["lang", "source"], "left").join(langs, "lang", "left").join(blocks, "lang")
        .na.fill(0, ["total", "held", "total_lang", "words"])
        .withColumn("p0", probability("CAST(0 AS BIGINT)", "total", "words"))
        .withColumn("b", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    )

    known = cells.join(groups, ["lang", "source"]).withColumn("p", probability("n", "total", "words"))
    terms = (
        known.withColumn("q", probability("n_lang", "total_lang", "words"))
        .where("p > q")
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(gap("p", "q")).alias("value"))
    )

    # sources meet in cells (block of the one, block of the other)
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    one = lambda df, *more: df.select("lang", "source", "p0", F.col("b").alias("ba"), others.alias("bb"), *more)
    two = lambda df, *more: df.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("b").alias("bb"), others.alias("ba"), *more)
    cell = ["lang", "ba", "bb"]
    both = (
        one(known, "term", "p").join(two(known, "term", F.col("p").alias("q")), [*cell, "term"]).where("source <> item")
        .select("lang", "source", "item", F.expr(f"{gap('p', 'q')} - {gap('p', 'q0')} - {gap('p0', 'q')} + {gap('p0', 'q0')}").alias("value"))
    )
    spread = known.groupBy("lang", "source", "p0", "b", "blocks", "p").agg(F.count(F.lit(1)).alias("k"))
    left = (
        one(spread, "p", "k").join(two(groups), cell).where("source <> item")
        .select("lang", "source", "item", F.expr(f"k * {gap('p', 'q0')}").alias("value"))
    )
    right = (
        one(groups).join(two(spread, F.col("p").alias("q"), "k"), cell).where("source <> item")
        .select("lang", "source", "item", F.expr(f"k * {gap('p0', 'q')}").alias("value"))
    )
    neither = (
        one(groups, "words", "held").join(two(groups, F.col("held").alias("held2")), cell).where("source <> item")
        .select("lang", "source", "item", F.expr(f"(words - held - held2) * {gap('p0', 'q0')}").alias("value"))
    )
    pairs = (
        both.unionByName(left).unionByName(right).unionByName(neither)
        .groupBy("lang", "source", "item").agg(F.coalesce(F.sum("value"), zero).alias("value"))
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    )
    w = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), F.col("item").asc())
    ranked = lambda df: df.withColumn("rank", F.row_number().over(w))
    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= top))
