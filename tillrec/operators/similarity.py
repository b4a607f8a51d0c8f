"""Cosine similarity and nearest neighbours (survey E1-E4, J3).

sim(a, b) = Σ_x v_ax·v_bx / (‖a‖·‖b‖) over the shared x.  Four ways to ask:

* ``cosine_pairs`` — every pair that shares an x, each once (a < b), by cells
  of a block of keys against another; products are summed where they are
  formed, and only sums leave a task.
* ``cosine_pairs`` with ``min_sim`` — only pairs above a threshold: by the same
  cells or, if fewer rows move, candidates from the prefixes of the vectors
  that are then compared by themselves.
* ``nearest_neighbors`` — the n best of each key by the same cells; no pair
  table is built.
* ``pair_similarity`` — requested pairs only.

Skew: the work is Σ_x d_x² products where d_x is the group size of x.  Rows
lie in the blocks of their keys, so a hot x is spread over all cells; joins
cut its group into parts of ``heavy_degree`` rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable
from .common import heavy_keys, salted_join, top_n_per_group

DEFAULT_HEAVY_DEGREE = 2000


def _cells(ix: DataFrame, key: str, other: str, value: str) -> DataFrame:
    """Non-zero cells (_k, _x, _v)."""
    return ix.where(F.col(key).isNotNull() & F.col(other).isNotNull() & (F.col(value) != 0)).select(
        F.col(key).alias("_k"), F.col(other).alias("_x"), F.col(value).cast("double").alias("_v")
    )


def _weighted(base: DataFrame) -> DataFrame:
    """Cells with the norm ``_n``, its square ``_s`` and the number of cells ``_d`` of their key."""
    norms = base.groupBy("_k").agg(F.sum(F.col("_v") * F.col("_v")).alias("_s"), F.count(F.lit(1)).alias("_d"))
    return base.join(norms.withColumn("_n", F.sqrt("_s")), "_k").select("_k", "_x", "_v", "_n", "_d", "_s")


def _meet(w: DataFrame, cols: list[str], heavy_degree: int | None, base: DataFrame | None = None) -> DataFrame:
    """Rows of ``w`` that share ``_x``, as <col>a and <col>b of ``cols``, keys
    a < b.  ``base`` (default ``w``) has the same ``_x`` and tells the heavy ones."""
    side = lambda s: [F.col(c).alias(c + s) for c in cols]
    if heavy_degree:
        w = w.join(heavy_keys(w if base is None else base, "_x", heavy_degree), "_x", "left").withColumn("_B", F.coalesce("_parts", F.lit(1)))
        w = w.withColumn("_c", F.pmod(F.xxhash64("_k"), F.col("_B")))
        rep = F.explode(F.sequence(F.lit(0), F.col("_B") - 1))
        left = w.select("_x", *side("a"), F.col("_c").alias("_j1"), rep.alias("_j2"))
        right = w.select("_x", *side("b"), rep.alias("_j1"), F.col("_c").alias("_j2"))
        joined = left.join(right, ["_x", "_j1", "_j2"])
    else:
        joined = w.select("_x", *side("a")).join(w.select("_x", *side("b")), "_x")
    return joined.where(F.col("_ka") < F.col("_kb"))


def cosine_pairs(
    ix: DataFrame,
    key: str,
    other: str,
    value: str = "transaction_count",
    heavy_degree: int | None = DEFAULT_HEAVY_DEGREE,
    out_a: str | None = None,
    out_b: str | None = None,
    min_sim: float = 0.0,
) -> DataFrame:
    """(a, b, sim) of the pairs a < b that share an x; with ``min_sim`` > 0
    those above it, found without summing the others."""
    out_a = out_a or f"{key}_a"
    out_b = out_b or f"{key}_b"
    w = reliable(_weighted(_cells(ix, key, other, value)))
    if min_sim > 0 and _prefixes_pay(w, min_sim):
        pairs = _probe(prefix_candidates(w, min_sim, heavy_degree), w)
        return pairs.where(F.col("sim") > min_sim).select(F.col("_ka").alias(out_a), F.col("_kb").alias(out_b), "sim")
    return _pair_sums(w, out_a, out_b, min_sim if min_sim > 0 else None, heavy_degree)


def user_similarity(ix: DataFrame, value: str = "transaction_count", heavy_degree: int | None = DEFAULT_HEAVY_DEGREE,
                    user: str = "client_id", item: str = "merchant_id", min_sim: float = 0.0) -> DataFrame:
    """(user_a, user_b, sim), user_a < user_b, sim > ``min_sim`` only."""
    return cosine_pairs(ix, user, item, value, heavy_degree, "user_a", "user_b", min_sim).where(F.col("sim") > min_sim)


def item_similarity(ix: DataFrame, value: str = "transaction_count", heavy_degree: int | None = DEFAULT_HEAVY_DEGREE,
                    user: str = "client_id", item: str = "merchant_id", min_sim: float = 0.0) -> DataFrame:
    """(item_a, item_b, sim > ``min_sim``) on the transpose."""
    return cosine_pairs(ix, item, user, value, heavy_degree, "item_a", "item_b", min_sim).where(F.col("sim") > min_sim)


# ---- from a bucketed table ----------------------------------------------------


def weighted_cells(ix: DataFrame, key: str, other: str, value: str = "transaction_count") -> DataFrame:
    """Cells (_k, _x, _v) with the norm ``_n`` of their key and the number
    ``_m`` of cells of their x; what the bucketed table holds."""
    base = _cells(ix, key, other, value)
    degree = base.groupBy("_x").agg(F.count(F.lit(1)).alias("_m"))
    return _weighted(base).join(degree, "_x").select("_x", "_k", "_v", "_n", "_m")


def bucketed_cosine_pairs(cells: DataFrame, heavy_degree: int = DEFAULT_HEAVY_DEGREE, out_a: str = "a", out_b: str = "b") -> DataFrame:
    """``cosine_pairs`` of a table written by ``write_cells``.  The cells of
    an x lie in one bucket, so those of ordinary x are joined in place; only
    the x above ``heavy_degree`` are dealt out in chunks, which shuffles them."""
    cols = ["_k", "_v", "_n"]
    light = _meet(cells.where(F.col("_m") <= heavy_degree).drop("_m"), cols, None)
    hot = cells.where(F.col("_m") > heavy_degree)
    parts = F.ceil(F.col("_m") / F.lit(heavy_degree)).cast("int")
    chunk, rep = F.pmod(F.xxhash64("_k"), parts).cast("int"), F.explode(F.sequence(F.lit(0), parts - 1))
    side = lambda s: [F.col(c).alias(c + s) for c in cols]
    dealt = hot.select("_x", *side("a"), chunk.alias("_j1"), rep.alias("_j2")).join(
        hot.select("_x", *side("b"), rep.alias("_j1"), chunk.alias("_j2")), ["_x", "_j1", "_j2"]).where(F.col("_ka") < F.col("_kb"))
    met = light.unionByName(dealt.select(*light.columns))
    pairs = met.groupBy("_ka", "_kb", "_na", "_nb").agg(F.sum(F.col("_va") * F.col("_vb")).alias("_dot"))
    return pairs.select(
        F.col("_ka").alias(out_a), F.col("_kb").alias(out_b), (F.col("_dot") / (F.col("_na") * F.col("_nb"))).alias("sim"))


# ---- requested pairs and pairs above a threshold ---------------------------

PROBE_ROWS = 100_000


def _probe(asked: DataFrame, w: DataFrame, chunk_rows: int = PROBE_ROWS) -> DataFrame:
    """(_ka, _kb, sim) of the distinct pairs ``asked`` (_ka, _kb) over the
    cells ``w``.  Only the shorter vector of a pair is laid out, in chunks of
    about ``chunk_rows`` cells, and meets the longer one cell by cell."""
    sizes = w.select("_k", "_n", "_d").distinct()
    side = lambda s: sizes.select(F.col("_k").alias("_k" + s), F.col("_n").alias("_n" + s), F.col("_d").alias("_d" + s))
    sized = asked.join(side("a"), "_ka").join(side("b"), "_kb")
    a_first = F.col("_da") <= F.col("_db")
    pick = lambda x, y, name: F.when(a_first, F.col(x)).otherwise(F.col(y)).alias(name)
    chunks = lambda d: F.ceil(F.col(d) / chunk_rows).cast("int")
    short = sized.select(
        "_ka", "_kb", "_na", "_nb", pick("_ka", "_kb", "_s"), pick("_kb", "_ka", "_l"),
        F.explode(F.sequence(F.lit(0), F.ceil(F.least("_da", "_db") / chunk_rows).cast("int") - 1)).alias("_c"),
    )
    cells = w.select(F.col("_k").alias("_s"), "_x", F.col("_v").alias("_vs"), F.pmod(F.xxhash64("_x"), chunks("_d")).cast("int").alias("_c"))
    longer = w.select(F.col("_k").alias("_l"), "_x", F.col("_v").alias("_vl"))
    dots = (
        short.join(cells, ["_s", "_c"]).join(longer, ["_l", "_x"])
        .groupBy("_ka", "_kb", "_na", "_nb").agg(F.sum(F.col("_vs") * F.col("_vl")).alias("_dot"))
    )
    return dots.select("_ka", "_kb", (F.col("_dot") / (F.col("_na") * F.col("_nb"))).alias("sim"))


def pair_similarity(
    pairs: DataFrame, ix: DataFrame, a: str, b: str, key: str = "merchant_id", other: str = "client_id",
    value: str = "transaction_count", chunk_rows: int = PROBE_ROWS,
) -> DataFrame:
    """Distinct (a, b) of ``pairs`` with their cosine ``sim``: 0 where they
    share nothing or are unknown.  No pair beyond those asked for is formed."""
    w = reliable(_weighted(_cells(ix, key, other, value)))
    asked = pairs.select(F.col(a).alias("_ka"), F.col(b).alias("_kb")).distinct()
    found = _probe(asked, w, chunk_rows)
    return asked.join(found, ["_ka", "_kb"], "left").select(
        F.col("_ka").alias(a), F.col("_kb").alias(b), F.coalesce("sim", F.lit(0.0)).alias("sim")
    )


def prefix_candidates(w: DataFrame, min_sim: float, heavy_degree: int | None = DEFAULT_HEAVY_DEGREE) -> DataFrame:
    """Pairs (_ka, _kb) that may have a cosine of ``min_sim`` or more, all of
    those that do among them.

    The x stand in one order, rare before frequent, in levels of like
    frequency.  Let l be the first level at which two vectors share an x: all
    they share lies from l on, so their cosine is at most ‖a from l‖·‖b from
    l‖ (unit vectors).  So only cells whose vector still has a norm of
    ``min_sim`` from their level on are joined (the prefix), and a row goes on
    only if the product of both norms reaches it.  Levels are summed per key,
    so a key with very many cells is no window of its own."""
    t = min_sim * (1 - 1e-9)
    met = _meet(_prefixes(w, t), ["_k", "_r"], heavy_degree).where(F.col("_ra") * F.col("_rb") >= t)
    return met.select("_ka", "_kb").distinct()


def _prefixes(w: DataFrame, t: float) -> DataFrame:
    """Cells (_k, _x) from whose level on the unit vector of the key has the norm ``_r`` of at least ``t``."""
    often = w.groupBy("_x").agg(F.floor(F.log2(F.count(F.lit(1))) * 4).cast("int").alias("_level"))
    unit = w.join(often, "_x").withColumn("_u", F.col("_v") / F.col("_n"))
    from_here = Window.partitionBy("_k").orderBy(F.col("_level").desc()).rowsBetween(Window.unboundedPreceding, 0)
    levels = unit.groupBy("_k", "_level").agg(F.sum(F.col("_u") * F.col("_u")).alias("_q"))
    rest = levels.select("_k", "_level", F.sqrt(F.sum("_q").over(from_here)).alias("_r")).where(F.col("_r") >= t)
    return unit.join(rest, ["_k", "_level"]).select("_k", "_x", "_r")


def _prefixes_pay(w: DataFrame, min_sim: float) -> bool:
    """Whether the candidates of the prefixes, laid out cell by cell, are
    surely fewer rows than the cells of all pairs that share an x."""
    squares = lambda t: t.groupBy("_x").agg(F.count(F.lit(1)).alias("_m")).agg(F.sum(F.col("_m") * F.col("_m")), F.sum("_m")).first()
    every, rows = squares(w)
    if not rows:
        return False
    met, _ = squares(_prefixes(w, min_sim * (1 - 1e-9)))
    return (met or 0) * rows / w.select("_k").distinct().count() < every


def approximate_item_pairs(
    ix: DataFrame, threshold: float, value: str = "transaction_count", user: str = "client_id", item: str = "merchant_id",
    oversample: float = 10.0, heavy_degree: int | None = DEFAULT_HEAVY_DEGREE,
) -> DataFrame:
    """E2, opt-in: item pairs with an estimate of their cosine by
    dimension-independent sampling.  With γ = ``oversample``·ln(items) /
    threshold, a cell of an item of norm ‖a‖ is kept with probability
    min(1, √γ/‖a‖) (by a hash, so reruns agree) and weighs v / min(√γ, ‖a‖);
    the sum of products of kept cells is an unbiased estimate.  The work per
    item is at most about γ whatever its number of users.  Pairs whose cosine
    is at least ``threshold`` are estimated within a relative error that
    falls with √``oversample``; smaller ones are noisier.  Items with
    ‖a‖² ≤ γ lose nothing, so small tables give exact values."""
    w = reliable(_weighted(_cells(ix, item, user, value)))
    n_items = w.select("_k").distinct().count()
    root = F.lit(float(np.sqrt(oversample * np.log(max(2, n_items)) / threshold)))
    chance = F.least(F.lit(1.0), root / F.col("_n"))
    draw = (F.pmod(F.xxhash64("_k", "_x"), F.lit(1 << 30)) + 0.5) / F.lit(float(1 << 30))
    weight = (F.col("_v") / F.least(root, F.col("_n"))).alias("_v")
    kept = w.where(draw < chance).select("_k", "_x", weight, F.lit(1.0).alias("_n"), "_d", F.lit(1.0).alias("_s"))
    sums = _pair_sums(reliable(kept), "item_a", "item_b", None, heavy_degree)
    return sums.withColumn("sim", F.least(F.lit(1.0), "sim"))


# ---- the n nearest of each key ----------------------------------------------


def mirror(pairs: DataFrame, a: str, b: str, key: str = "id", other: str = "neighbor") -> DataFrame:
    """Both directions of each unordered pair: (key, neighbor, sim), from one
    pass over the pair table."""
    both = F.array(
        F.struct(F.col(a).alias(key), F.col(b).alias(other), F.col("sim")),
        F.struct(F.col(b).alias(key), F.col(a).alias(other), F.col("sim")),
    )
    return pairs.select(F.explode(both).alias("_p")).select("_p.*")


def _best(sims: DataFrame, key: str, other: str, n: int, digits: int) -> DataFrame:
    m = sims.withColumn("_s", F.round("sim", digits))
    return top_n_per_group(m, [key], [F.col("_s").desc(), F.col(other).asc()], n).drop("_s")


def nearest(pairs: DataFrame, a: str, b: str, n: int = 10, key: str = "id", other: str = "neighbor",
            digits: int = 9) -> DataFrame:
    """E3/E4 from a table of pairs: the n most similar others of each key by
    (sim desc, id asc); self is excluded by construction (no pair has a = b)."""
    return _best(mirror(pairs, a, b, key, other), key, other, n, digits)


# Rows of one block of keys (a cell holds two blocks, some 25 bytes a row);
# products a cell should form on average; rows that are packed into lists and
# products that are held at a time; entries of the short lists that leave a
# cell in one row and that are merged at a time.
BLOCK_CELLS = 12_000_000
CELL_PRODUCTS = 16_000_000
HELD_CELLS = 200_000
PRODUCTS = 2_000_000
LIST_ENTRIES = 500_000
MERGED_ENTRIES = 4_000_000


def _grid(w: DataFrame, rows: int, block_cells: int) -> tuple[int, float]:
    """Number of key blocks, and the mean group that a row stands in.  A row goes to as many cells as there are blocks, so
    there are only as many as memory and the cores ask for."""
    m = F.col("_m").cast("double")
    products = w.groupBy("_x").agg(F.count(F.lit(1)).alias("_m")).agg(F.sum(m * m)).first()[0] or 0.0
    cells = w.sparkSession.sparkContext.defaultParallelism
    if products > cells * CELL_PRODUCTS:
        cells *= 3
    return max(1, -(-rows // block_cells), int(np.ceil(np.sqrt(2 * cells + 0.25) - 0.5))), products / max(1, rows)


def _narrow(w: DataFrame) -> DataFrame:
    """Rows (_x, _k, _v, _s, _q), numbers in two or four bytes where that loses nothing for any row."""
    whole = lambda c, bits: F.bool_and((F.col(c) == F.floor(c)) & F.col(c).between(-(2 ** (bits - 1)), 2 ** (bits - 1) - 1))
    single = lambda c: F.bool_and(F.col(c).cast("float").cast("double") == F.col(c))
    tries = [("_v", "smallint", whole("_v", 16)), ("_v", "float", single("_v")), ("_s", "smallint", whole("_s", 16)), ("_s", "float", single("_s"))]
    tries += [(c, "int", whole(c, 32)) for c in ("_k", "_x") if dict(w.dtypes)[c] == "bigint"]
    fits = w.agg(*[fit for _, _, fit in tries]).first()
    to = {c: t for (c, t, _), fit in reversed(list(zip(tries, fits))) if fit}
    cols = [F.col(c).cast(to[c]).alias(c) if c in to else F.col(c) for c in ("_x", "_k", "_v", "_s")]
    return w.select(*cols, (F.col("_q") if "_q" in w.columns else F.lit(True)).alias("_q"))


def _packed(batches, held_rows: int):
    """Rows (_g, _x, _k, _v, _s, _q) as one row of lists for each ``_g``: of
    its keys (_k, _s, _q and the number of their rows, _len) and of its rows
    (_x, _v), key by key."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= held_rows:
            yield from _lists(held)
            held, rows = [], 0
    if rows:
        yield from _lists(held)


def _lists(batches: list[pa.RecordBatch]):
    t = pa.Table.from_batches(batches).combine_chunks()
    column = lambda c: t.column(c).combine_chunks()
    key = column("_k").dictionary_encode()
    key = (key.combine_chunks() if isinstance(key, pa.ChunkedArray) else key).indices.to_numpy()
    group = column("_g").to_numpy()
    order = np.lexsort((key, group))
    key, group, t = key[order], group[order], t.take(pa.array(order))
    runs = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (group[1:] != group[:-1])))
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    of_rows = pa.array(np.append(first, len(group)), pa.int32())
    of_runs = pa.array(np.append(np.searchsorted(runs, first), len(runs)), pa.int32())
    out = {"_g": pa.array(group[first])}
    for c in ("_k", "_s", "_q"):
        out[c] = pa.ListArray.from_arrays(of_runs, column(c).take(pa.array(runs)))
    out["_len"] = pa.ListArray.from_arrays(of_runs, pa.array(np.diff(np.append(runs, len(group))), pa.int32()))
    for c in ("_x", "_v"):
        out[c] = pa.ListArray.from_arrays(of_rows, column(c))
    yield from pa.table(out).to_batches()


def _by_cells(w: DataFrame, rows: int, block_cells: int, fn, schema: str) -> tuple[DataFrame, int]:
    """``fn(a, b, same)`` over the cells of two key blocks each, a block with
    itself included, and the number of blocks.  Every pair of keys meets in
    one cell, which has all their rows, so sums are complete there.

    A row goes to all cells of its block, packed with others of its key, some
    five bytes for each number pair.  Where groups are smaller than the number
    of blocks, it goes only to the cells whose other block has a key of its x."""
    blocks, mean = _grid(w, rows, block_cells)
    held_rows = HELD_CELLS
    w = _narrow(w).withColumn("_b", F.pmod(F.xxhash64("_k", F.lit(1)), F.lit(blocks)))
    cell = lambda other: F.least("_b", other) * blocks + F.greatest("_b", other)
    everywhere = 2 * mean >= blocks
    if everywhere:
        w = w.withColumn("_g", F.col("_b"))
    else:
        met = w.groupBy("_x").agg(F.collect_set("_b").alias("_to"))
        w = w.join(met, "_x").withColumn("_g", F.explode(F.transform("_to", lambda o: cell(o) * blocks + F.col("_b"))))
    kind = dict(w.dtypes)
    lists = w.select("_g", "_x", "_k", "_v", "_s", "_q").mapInArrow(
        lambda batches: _packed(batches, held_rows),
        f"_g bigint, _k array<{kind['_k']}>, _s array<{kind['_s']}>, _q array<boolean>, _len array<int>, _x array<{kind['_x']}>, _v array<{kind['_v']}>")
    if everywhere:
        others = F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")
        dealt = lists.withColumnRenamed("_g", "_b").withColumn("_cell", F.explode(F.transform(others, cell)))
    else:
        dealt = lists.withColumn("_cell", F.floor(F.col("_g") / blocks)).withColumn("_b", F.pmod("_g", F.lit(blocks))).drop("_g")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames), ignore_index=True)
        i, j = divmod(int(rows["_cell"].iloc[0]), blocks)
        a = _Side(rows[rows["_b"] == i])
        b = a if i == j else _Side(rows[rows["_b"] == j])
        del rows
        if a.rows and b.rows:
            yield from fn(a, b, i == j)

    cells = blocks * (blocks + 1) // 2
    return dealt.repartition(cells, "_cell").groupBy("_cell").applyInPandas(run, schema), blocks


class _Side:
    """The keys of a block, in runs, and their rows."""

    def __init__(self, lists: pd.DataFrame):
        self.rows = 0
        if len(lists):
            flat = lambda c: np.concatenate(lists[c].to_list())
            self.keys, self.square, self.asked, self.len = flat("_k"), flat("_s").astype(float), flat("_q").astype(bool), flat("_len")
            self.x, self.v = flat("_x"), flat("_v")
            self.rows = len(self.x)


def _cell_sums(a: _Side, b: _Side, ways: int):
    """(names, x, y, sim): sums of products of the keys of a cell as codes of
    ``names``, in the order of the names, x by x.  With one way every pair
    comes once; with two every asked x comes with all its y."""
    same = a is b
    names, code = np.unique(a.keys if same else np.concatenate([a.keys, b.keys]), return_inverse=True)
    code = code.astype(np.int32)
    norm, asked = np.empty(len(names)), np.zeros(len(names), bool)
    at, _ = pd.factorize(a.x if same else np.concatenate([a.x, b.x]))
    width = int(at.max()) + 1
    sides, seen, run = [], 0, 0
    for side in (a,) if same else (a, b):
        mine = code[run : run + len(side.keys)]
        norm[mine] = np.sqrt(side.square)
        asked[mine] = side.asked
        sides.append((np.repeat(mine, side.len), at[seen : seen + side.rows].astype(np.int32), side.v))
        seen, run = seen + side.rows, run + len(side.keys)
    del at, code
    for own, other in ((sides[0], sides[-1]), (sides[-1], sides[0]))[: 1 if same else ways]:
        key, x, v = other
        order = np.lexsort((key, x)) if same and ways == 1 else np.argsort(x, kind="stable")
        edge = np.append(0, np.cumsum(np.bincount(x, minlength=width)))
        held, value = key[order], v[order].astype(float)
        key, x, v = own
        first, last = edge[x], edge[x + 1]
        if same and ways == 1:  # the keys behind its own
            first[order] = np.arange(1, len(order) + 1)
        some = last > first
        if ways == 2:
            some &= asked[key]
        some = np.flatnonzero(some)
        order = some[np.argsort(key[some], kind="stable")]
        for p, q, dot in _products(key[order], v[order].astype(float), first[order], last[order], held, value, len(names)):
            yield names, p, q, dot / (norm[p] * norm[q])


def _pair_sums(w: DataFrame, out_a: str, out_b: str, above: float | None = None, heavy_degree: int | None = DEFAULT_HEAVY_DEGREE,
               block_cells: int = BLOCK_CELLS) -> DataFrame:
    """(a, b, sim) of the pairs a < b of the cells ``w`` that share an x; only those with sim > ``above``, if given.
    A large group needs no cutting here (``heavy_degree``): its rows lie in the blocks of their keys."""
    rows, largest = w.agg(F.count(F.lit(1)), F.max("_d")).first()
    kind = dict(w.dtypes)["_k"]

    def cell(a: _Side, b: _Side, same: bool):
        for names, x, y, sim in _cell_sums(a, b, 1):
            some = x != y
            if above is not None:
                some &= sim > above
            x, y, sim = x[some], y[some], sim[some]
            yield pd.DataFrame({out_a: names[np.minimum(x, y)], out_b: names[np.maximum(x, y)], "sim": sim})

    pairs, _ = _by_cells(w.where(F.col("_d") <= block_cells), rows, block_cells, cell, f"`{out_a}` {kind}, `{out_b}` {kind}, sim double")
    if largest is not None and largest > block_cells:
        heavy = _heavy_sums(w, block_cells).select(F.least("_k", "_kh").alias(out_a), F.greatest("_k", "_kh").alias(out_b), "sim")
        pairs = pairs.unionByName(heavy if above is None else heavy.where(F.col("sim") > above))
    return pairs


def keep_best(group: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    """Which rows are the ``n`` of largest score of their group, the first of equal ones; ``group`` rises from 0 on."""
    size = np.bincount(group)
    if not len(group) or size.max() <= n:
        return np.ones(len(group), bool)
    begin = np.cumsum(size) - size
    if len(size) * size.max() > 8 * len(group) + 1000:
        order = np.lexsort((-score, group))
        keep = np.empty(len(group), bool)
        keep[order] = np.arange(len(group)) - begin[group] < n
        return keep
    table = np.full((len(size), size.max()), -np.inf)
    table[group, np.arange(len(group)) - begin[group]] = score
    floor = np.partition(table, -n, axis=1)[:, -n][group]
    above, tie = score > floor, score == floor
    ties = np.cumsum(tie) - tie
    room = n - np.bincount(group[above], minlength=len(size))
    return above | (tie & (ties - ties[begin[group]] < room[group]))


def nearest_neighbors(
    ix: DataFrame, key: str = "client_id", other: str = "merchant_id", value: str = "transaction_count", n: int = 10,
    wanted: DataFrame | None = None, out_key: str = "id", out_other: str = "neighbor", digits: int = 9,
    block_cells: int = BLOCK_CELLS,
) -> DataFrame:
    """(key, neighbor, sim, rank), the n others of each key with the
    largest cosine above 0, by (sim rounded to ``digits`` desc, id asc), for
    all keys or those of ``wanted`` (a table with the column ``key``).

    Keys are cut into blocks of at most about ``block_cells`` cells.  A cell
    of two blocks gets the rows of both, so its sums are complete; it keeps n
    per key, and only those lists are shuffled, packed, and merged.  A key
    with more than ``block_cells`` cells (there are at most rows /
    ``block_cells``) would overfill a block: its pairs are summed by a join
    instead."""
    w = _weighted(_cells(ix, key, other, value))
    if wanted is not None:
        w = w.join(wanted.select(F.col(key).alias("_k")).distinct().withColumn("_q", F.lit(True)), "_k", "left")
        w = w.withColumn("_q", F.coalesce("_q", F.lit(False)))
    else:
        w = w.withColumn("_q", F.lit(True))
    w = reliable(w)
    rows, largest, n_keys = w.agg(F.count(F.lit(1)), F.max("_d"), F.approx_count_distinct("_k")).first()
    kind = dict(w.dtypes)["_k"]
    light = w.where(F.col("_d") <= block_cells)
    groups = max(w.sparkSession.sparkContext.defaultParallelism, -(-n_keys * n // MERGED_ENTRIES))

    def cell(a: _Side, b: _Side, same: bool):
        found, held = [], 0
        for names, x, y, sim in _cell_sums(a, b, 2):
            some = (x != y) & (sim > 0)
            x, y, sim = x[some], y[some], sim[some]
            some = keep_best(np.cumsum(np.append(0, x[1:] != x[:-1]))[: len(x)], np.round(sim, digits), n)
            found.append((names[x[some]], names[y[some]], sim[some]))
            held += int(some.sum())
            if held >= LIST_ENTRIES:
                yield _short_lists(found, groups)
                found, held = [], 0
        if held:
            yield _short_lists(found, groups)

    def merge(lists: pa.Table) -> pa.Table:
        flat = lambda c: lists.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        a, b, sim = flat("_a"), flat("_h"), flat("_sim")
        names, who = np.unique(a, return_inverse=True)
        order = np.lexsort((b, who))
        order = order[keep_best(who[order], np.round(sim[order], digits), n)]
        order = order[np.lexsort((b[order], -np.round(sim[order], digits), who[order]))]
        rank = np.arange(len(order)) - np.searchsorted(who[order], who[order], "left") + 1
        kinds = [lists.schema.field(c).type.value_type for c in ("_a", "_h")]
        return pa.table({out_key: pa.array(a[order], kinds[0]), out_other: pa.array(b[order], kinds[1]),
                         "sim": pa.array(sim[order], pa.float64()), "rank": pa.array(rank, pa.int32())})

    lists, _ = _by_cells(light, rows, block_cells, cell, f"_to int, _a array<{kind}>, _h array<{kind}>, _sim array<double>")
    if largest is not None and largest > block_cells:
        sims = lists.select(F.explode(F.arrays_zip("_a", "_h", "_sim")).alias("_p")).select(
            F.col("_p._a").alias(out_key), F.col("_p._h").alias(out_other), F.col("_p._sim").alias("sim"))
        return _best(sims.unionByName(_heavy_pairs(w, block_cells, out_key, out_other)), out_key, out_other, n, digits)
    return lists.groupBy("_to").applyInArrow(merge, f"`{out_key}` {kind}, `{out_other}` {kind}, sim double, rank int")


def _short_lists(found: list, groups: int) -> pd.DataFrame:
    """(a, b, sim) as one row of lists for each group of keys."""
    a, b, sim = (np.concatenate(c) for c in zip(*found))
    to = (pd.util.hash_array(a) % np.uint64(groups)).astype(np.int32)
    order = np.argsort(to, kind="stable")
    a, b, sim, to = a[order], b[order], sim[order], to[order]
    first = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
    cut = lambda c: np.split(c, first[1:])
    return pd.DataFrame({"_to": to[first], "_a": cut(a), "_h": cut(b), "_sim": cut(sim)})


def _heavy_sums(w: DataFrame, block_cells: int) -> DataFrame:
    """(_k, _kh, sim) of the pairs with a key _kh of more than ``block_cells`` cells, each once."""
    flags = [c for c in ("_q",) if c in w.columns]
    heavy = w.where(F.col("_d") > block_cells).select(
        "_x", F.col("_k").alias("_kh"), F.col("_v").alias("_vh"), F.col("_n").alias("_nh"), *[F.col(c).alias(c + "h") for c in flags])
    once = (F.col("_d") <= block_cells) | (F.col("_k") < F.col("_kh"))
    return (
        salted_join(w, heavy, "_x").where(once & (F.col("_k") != F.col("_kh")))
        .groupBy("_k", "_kh", "_n", "_nh", *flags, *[c + "h" for c in flags]).agg(F.sum(F.col("_v") * F.col("_vh")).alias("_dot"))
        .withColumn("sim", F.col("_dot") / (F.col("_n") * F.col("_nh")))
    )


def _heavy_pairs(w: DataFrame, block_cells: int, key: str, other: str) -> DataFrame:
    """Both directions of the pairs with a key of more than ``block_cells`` cells."""
    sums = _heavy_sums(w, block_cells).where(F.col("_dot") > 0)
    way = lambda q, a, b: F.struct(F.col(q).alias("q"), F.col(a).alias(key), F.col(b).alias(other), F.col("sim"))
    both = sums.select(F.explode(F.array(way("_q", "_k", "_kh"), way("_qh", "_kh", "_k"))).alias("_p")).select("_p.*")
    return both.where("q").drop("q")


def _products(a, v, first, last, held, value, width: int):
    """Sums of products of the rows (a, v), sorted by a, each with the held
    rows from ``first`` to ``last``: (a, b, dot), complete for every a."""
    ends = np.append(np.flatnonzero(np.diff(a)) + 1, len(a))  # of each key's rows
    work = np.cumsum(last - first)
    start = 0
    while start < len(a):
        done = work[start - 1] if start else 0
        stop = int(ends[max(np.searchsorted(work[ends - 1], done + PRODUCTS, "right") - 1, np.searchsorted(ends, start, "right"))])
        total = None
        for lo in _steps(work, start, stop, done):  # a single key may need several
            size = last[lo] - first[lo]
            at = np.repeat(first[lo] - np.cumsum(size) + size, size) + np.arange(size.sum())
            code = np.repeat(a[lo].astype(np.int64) * width, size) + held[at]
            sums = _sum_by(code, np.repeat(v[lo], size) * value[at])
            total = sums if total is None else _sum_by(*(np.concatenate(c) for c in zip(total, sums)))
        x, y = np.divmod(total[0], width)
        yield x, y, total[1]
        start = stop


def _sum_by(code, value):
    """The distinct codes, rising, and the sums of their values."""
    order = np.argsort(code)
    code = code[order]
    starts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    return code[starts], np.add.reduceat(value[order], starts)


def _steps(work, start: int, stop: int, done: int):
    """Row ranges of about PRODUCTS products each."""
    while start < stop:
        end = min(stop, max(start + 1, int(np.searchsorted(work, done + PRODUCTS, "right"))))
        yield slice(start, end)
        start, done = end, work[end - 1]
