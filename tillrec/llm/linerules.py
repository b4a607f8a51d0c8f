"""Quality rules with cross-document line frequency.

Every line is normalised (lower case, white space and digit runs made one)
and hashed with its host.  A line that stands in more different documents of
its host than the limit is boilerplate: it is taken out, and a document of
which too little is left is rejected.  Base rules on the document itself come
first.

Copies of a document say nothing about boilerplate, so equal texts of one host
count as one document, and its lines are looked up once for all copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillrec.llm.common import col, free_columns, reliable

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
OUT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
#: Keys with more than this share of all rows (and HOT_ROWS) are few by arithmetic: under 100,000, some MB.
HOT_SHARE = 100_000
HOT_ROWS = 10_000


def repeat_words(words: str) -> list[tuple[str, Column]]:
    """Columns that lead from an array of words to ``n_repeat_words``, the
    words under three-word windows that occur twice or more.

    Hashes of the windows tell at once that none repeats.  Otherwise the
    windows themselves are sorted with their places, equal neighbours give
    the places, and each place covers three words less what the next covers."""
    w = F.col(words)
    starts = F.sequence(F.lit(0), F.size(w) - 3)
    at = lambda i: F.get(w, i)
    hashes = F.when(F.size(w) > 3, F.transform(starts, lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2))))
    ordered = F.when(
        F.size("__hashes") > F.size(F.array_distinct("__hashes")),
        F.sort_array(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", at(i), at(i + 1), at(i + 2)).alias("g"), i.alias("i")))),
    )
    o = F.col("__ordered")
    same = lambda x, k: F.coalesce(F.get(o, k)["g"] == x["g"], F.lit(False))
    places = F.sort_array(F.transform(F.filter(o, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))
    p = F.col("__places")
    cover = F.transform(p, lambda x, k: F.coalesce(F.least(F.lit(3), F.get(p, k + 1) - x), F.lit(3)))
    total = F.aggregate(cover, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return [("__hashes", hashes), ("__ordered", ordered), ("__places", places), ("n_repeat_words", F.coalesce(total, F.lit(0)))]


def base_rules(docs: DataFrame, text_col: str = "text", min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """``docs`` with the base counts and ``base_failed`` (see ``OUT``)."""
    text = F.coalesce(col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.regexp_like(x, F.lit(WORD)))
    out = docs.withColumn("__words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).withColumn("__lines", lines)
    for name, column in repeat_words("__words"):
        out = out.withColumn(name, column)
    return (
        out.withColumn("n_words", F.size("__words").cast("bigint"))
        .withColumn("word_chars", (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("bigint"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit(SYMBOL)).cast("bigint"))
        .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"))
        .withColumn("base_failed", (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent))
        .drop("__words", "__lines", "__hashes", "__ordered", "__places")
    )


def hashed_lines(text: Column, host: Column) -> Column:
    """Array of (``k``, hash of host and normalised line; ``w``, its words) of every line with a word."""
    flat = F.regexp_replace(F.regexp_replace(F.lower(text), r"[\x20\x09\x0B-\x0D]+", " "), "[0-9]+", "0")
    lines = F.filter(F.transform(F.split(flat, "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(F.xxhash64(host, x).alias("k"), F.size(F.split(x, " ", -1)).alias("w")))


def line_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_docs: int = 10,
    host_share: float = 0.001,
    min_words: int = 50,
    min_left_percent: int = 50,
    max_repeat_percent: int = 50,
    carry: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per document: id, ``n_words``, ``word_chars``, ``n_symbols``,
    ``n_dup_lines``, ``n_repeat_words``, ``base_failed``, ``n_left`` (words
    outside boilerplate lines) and ``kept``.

    A line is boilerplate if more than ``min_docs`` different texts of its
    host hold it, and more than ``host_share`` of the host's different texts.
    A document is kept unless it failed the base rules, has fewer than
    ``min_words`` words left or less than ``min_left_percent`` per cent of
    its words.  With ``carry`` all columns of ``docs`` stay (those that
    clash with the new names go) and ``cleaned`` holds the text without its
    boilerplate lines.

    Null text counts as empty (all counts 0, not kept); null hosts form one
    host; lines without a word are neither counted nor removed; equal rows
    each give a row; an empty table gives an empty result.
    """
    new = [*OUT, "n_left", "kept", "cleaned"]
    keep = free_columns(docs, new) if carry else [id_col]
    text = F.coalesce(col(text_col), F.lit(""))
    own = docs.select(
        *[col(c).alias(f"__c{i}") for i, c in enumerate(keep)],
        text.alias("__text"),
        col(host_col).cast("string").alias("__host"),
    )
    based = base_rules(own, "__text", min_words, max_repeat_percent).select(
        *[F.col(f"__c{i}") for i in range(len(keep))],
        *(["__text"] if carry else []),
        "__host",
        *OUT,
        F.unhex(F.md5(F.encode("__text", "UTF-8"))).alias("__d"),
        hashed_lines(F.col("__text"), F.col("__host")).alias("__l"),
    )
    rows = reliable(based)

    # one document per host and text
    key = ["__host", "__d"]
    host_of = F.coalesce(F.concat(F.lit("h"), F.col("__host")), F.lit("n"))  # null as a value of its own
    texts = reliable(
        rows.groupBy(host_of.alias("__host"), "__d").agg(F.first("__l").alias("__l"), F.count(F.lit(1)).alias("__copies"))
    )
    limits = texts.groupBy("__host").agg(F.greatest(F.lit(float(min_docs)), F.count(F.lit(1)) * host_share).alias("__limit"))
    found = (
        texts.select("__host", F.explode(F.array_distinct(F.col("__l.k"))).alias("k"))
        .groupBy("__host", "k")
        .agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") > min_docs)
    )
    frequent = reliable(found.join(limits, "__host").where(F.col("__n") > F.col("__limit")).select("k", "__n"))

    def floor_of(total: int) -> int:
        return max(hot_rows, total // HOT_SHARE)  # fewer than HOT_SHARE keys can have more rows

    n_rows, n_lines = rows.count(), texts.agg(F.coalesce(F.sum(F.size("__l")), F.lit(0))).first()[0]
    lines = texts.select("__host", "__d", F.explode("__l").alias("__x")).select("__host", "__d", "__x.k", "__x.w")
    hot = F.broadcast(frequent.where(F.col("__n") > floor_of(n_lines)).select("k"))
    cold = frequent.where(F.col("__n") <= floor_of(n_lines)).select("k")
    hits = lines.join(hot, "k").unionByName(lines.join(hot, "k", "left_anti").join(cold, "k"))
    gone = [F.sum("w").alias("__gone")] + ([F.collect_set("k").alias("__ks")] if carry else [])
    removed = reliable(hits.groupBy(*key).agg(*gone).join(texts.select(*key, "__copies"), key))

    # back to the rows: texts with very many copies by broadcast, the others by shuffle
    many = removed.where(F.col("__copies") > floor_of(n_rows)).drop("__copies")
    few = removed.where(F.col("__copies") <= floor_of(n_rows)).drop("__copies")
    rows = rows.drop("__l").withColumn("__host", host_of)
    first = rows.join(F.broadcast(many.select(*key, F.lit(True).alias("__many"))), key, "left")
    out = (
        first.where(F.col("__many")).drop("__many").join(F.broadcast(many), key)
        .unionByName(first.where(F.col("__many").isNull()).drop("__many").join(few, key, "left"))
    )
    left = F.col("n_words") - F.coalesce(F.col("__gone"), F.lit(0))
    kept = ~F.col("base_failed") & (left >= min_words) & (left * 100 >= F.col("n_words") * min_left_percent)
    extra = []
    if carry:
        own_lines = F.split("__text", "\n", -1)
        host = F.when(F.col("__host").startswith("h"), F.substring("__host", 2, 1 << 30))
        keys = lambda x: F.get(hashed_lines(x, host), F.lit(0))["k"]
        clean = F.array_join(F.filter(own_lines, lambda x: ~F.coalesce(F.array_contains("__ks", keys(x)), F.lit(False))), "\n")
        extra = [F.when(F.col("__ks").isNull(), F.col("__text")).otherwise(clean).alias("cleaned")]
    return out.select(
        *[F.col(f"__c{i}").alias(c) for i, c in enumerate(keep)], *OUT, left.alias("n_left"), kept.alias("kept"), *extra
    )


def line_rules_digest(docs: DataFrame, **options) -> DataFrame:
    return line_rules(docs, **options).drop("n_left")
