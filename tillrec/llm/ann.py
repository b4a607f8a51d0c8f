"""Nearest neighbours by inner product over randomly rotated one-bit codes.

Every vector is centred, randomly rotated into ``WIDER`` times as many
dimensions and kept as the signs of its coordinates there (packed bits) with
two correction scalars: its distance to the centre and how well the signs
align with it.  For a query the bits estimate every inner product, with an
error bound that falls with the number of bits.  A first pass forms the exact
products of the best estimates of each block of rows; the k-th of them, over
all tasks, is a floor that the query's k-th best cannot lie below.  The second
pass reranks, by exact products, the vectors whose upper estimate reaches it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillrec.llm.common import col, reliable

#: Queries of one pass; with D dimensions a block is 8 x D x this many bytes.
QUERY_BLOCK = 16_384
ROW_BLOCK = 8_192
QUERY_SUB = 512
#: Error bounds in standard deviations of the estimate's error.
EPSILON = 4.0
#: Bits of a code per dimension of its vector.
WIDER = 4


def usable(v: Column) -> Column:
    """Vectors with a component other than zero and none null or not finite."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random matrix with orthonormal columns, ``WIDER`` x dim by dim, the same in every process."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((WIDER * dim, dim)))
    return q * np.sign(np.diag(r))


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows and one vector, added up from the first component
    to the last: equal vectors get equal products wherever they stand."""
    return np.cumsum(x * q, axis=1)[:, -1]


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, distance to the centre, alignment of signs and vector."""
    y = (x - centre) @ turn.T
    norm = np.sqrt((y * y).sum(axis=1))
    safe = np.where(norm > 0, norm, 1.0)
    align = np.where(norm > 0, np.abs(y / safe[:, None]).sum(axis=1) / np.sqrt(y.shape[1]), 1.0)
    return np.packbits(y > 0, axis=1), norm, align


def _centre(rows: DataFrame, dim: int) -> np.ndarray:
    """Mean of all vectors, from one partial sum per task."""

    def sums(batches):
        import pyarrow as pa

        total, n = np.zeros(dim), 0
        for b in batches:
            v = b.column(0).values.to_numpy(zero_copy_only=False).reshape(-1, dim)
            total += v.sum(axis=0)
            n += len(v)
        yield pa.RecordBatch.from_pydict({"i": np.arange(dim + 1), "s": np.append(total, float(n))})

    got = rows.select("v").mapInArrow(sums, "i bigint, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
    s = np.array([r["s"] for r in got])
    return s[:-1] / max(1.0, s[-1])


def encode_vectors(rows: DataFrame, dim: int, centre: np.ndarray, seed: int) -> DataFrame:
    """The index: id, original vector, ``code`` (packed bits), ``norm``, ``align``."""

    def codes(batches):
        import pyarrow as pa

        turn = rotation(dim, seed)
        for b in batches:
            v = b.column(1).values.to_numpy(zero_copy_only=False).reshape(-1, dim)
            bits, norm, align = encode(v, centre, turn)
            packed = pa.array([x.tobytes() for x in bits], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), packed, pa.array(norm), pa.array(align)], names=["id", "v", "code", "norm", "align"])

    return rows.select("id", "v").mapInArrow(codes, "id bigint, v array<double>, code binary, norm double, align double")


class Best:
    """The k best (score, id) of each query so far; an id counts once."""

    def __init__(self, queries: int, k: int):
        self.k, self.q = k, np.empty(0, np.int64)
        self.s, self.i = np.empty(0), np.empty(0, np.int64)
        self.floor = np.full(queries, -np.inf)

    def add(self, q: np.ndarray, s: np.ndarray, i: np.ndarray) -> None:
        q, s, i = np.concatenate([self.q, q]), np.concatenate([self.s, s]), np.concatenate([self.i, i])
        o = np.lexsort((-s, i, q))
        q, s, i = q[o], s[o], i[o]
        first = np.ones(len(q), bool)
        first[1:] = (q[1:] != q[:-1]) | (i[1:] != i[:-1])
        q, s, i = q[first], s[first], i[first]
        o = np.lexsort((i, -s, q))
        q, s, i = q[o], s[o], i[o]
        start = np.searchsorted(q, q, side="left")
        keep = np.arange(len(q)) - start < self.k
        self.q, self.s, self.i = q[keep], s[keep], i[keep]
        n = np.bincount(self.q, minlength=len(self.floor))
        full = np.flatnonzero(n >= self.k)
        end = np.searchsorted(self.q, full, side="right") - 1
        self.floor[full] = self.s[end]


def search_block(best: Best, q_ids, q, q_turned, q_norm, q_centre, ids, x, bits, norm, align, k: int, floors=None) -> int:
    """Compare a block of queries with a block of rows; returns pairs reranked.

    Without ``floors`` the k best estimates of each query are reranked; with
    them every row whose upper estimate reaches the query's floor."""
    wide = q_turned.shape[1]
    scale = max(float(norm.max()), 1e-300)
    n = norm / scale
    signs = np.unpackbits(bits, axis=1, count=wide).astype(np.float32) * 2 - 1
    by = (n / (align * np.sqrt(wide))).astype(np.float32)
    err = (n * np.sqrt(np.maximum(0.0, 1 - align**2)) / align * EPSILON / np.sqrt(max(1, wide - 1)) + 1e-5 * (n + 1)).astype(np.float32)
    reranked = 0
    for a in range(0, len(q), QUERY_SUB):
        b = min(a + QUERY_SUB, len(q))
        est = q_turned[a:b] @ signs.T
        est *= by
        if floors is None:
            m = min(len(ids), k + 1)  # one more, as the query's own row may be among them
            top = np.argpartition(est, len(ids) - m, axis=1)[:, len(ids) - m :] if m < len(ids) else np.broadcast_to(np.arange(m), (b - a, m))
            at_q, at_x = np.repeat(np.arange(b - a), m), top.ravel()
        else:
            floor = (floors[a:b] / q_norm[a:b] - q_centre[a:b]) / scale
            est += err
            at_q, at_x = np.nonzero(est >= np.maximum(floor, -3e38).astype(np.float32)[:, None] - 1e-5)
        cut = np.searchsorted(at_q, np.arange(b - a + 1))
        found = []
        for j in range(b - a):
            them = at_x[cut[j] : cut[j + 1]]
            them = them[ids[them] != q_ids[a + j]]
            if not len(them):
                continue
            reranked += len(them)
            score = products(x[them], q[a + j])
            good = score >= (best.floor[a + j] if floors is None else max(floors[a + j], best.floor[a + j]))
            found.append((np.full(int(good.sum()), a + j), score[good], ids[them[good]]))
        if found:
            best.add(*(np.concatenate(c) for c in zip(*found)))
    return reranked


def _search(index: DataFrame, q_ids: np.ndarray, q: np.ndarray, dim: int, centre: np.ndarray, k: int, seed: int, floors=None) -> DataFrame:
    """Each task's (query_id, vec_id, score) of one pass."""
    shared = index.sparkSession.sparkContext.broadcast((q_ids, q, floors))

    def run(batches):
        import pyarrow as pa

        q_ids, q, floors = shared.value
        norm = np.sqrt((q * q).sum(axis=1))
        turned = ((q / norm[:, None]) @ rotation(dim, seed).T).astype(np.float32)
        centred = (q / norm[:, None]) @ centre
        best = Best(len(q), k)
        held: list = []
        count = 0

        def flush():
            ids = np.concatenate([h[0] for h in held])
            x = np.concatenate([h[1] for h in held])
            bits = np.concatenate([h[2] for h in held])
            n, al = np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held])
            for s in range(0, len(ids), ROW_BLOCK):
                e = s + ROW_BLOCK
                search_block(best, q_ids, q, turned, norm, centred, ids[s:e], x[s:e], bits[s:e], n[s:e], al[s:e], k, floors)

        for b in batches:
            if not b.num_rows:
                continue
            held.append((
                b.column(0).to_numpy(zero_copy_only=False),
                b.column(1).values.to_numpy(zero_copy_only=False).reshape(-1, dim),
                np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, -1),
                b.column(3).to_numpy(zero_copy_only=False),
                b.column(4).to_numpy(zero_copy_only=False),
            ))
            count += b.num_rows
            if count >= ROW_BLOCK:
                flush()
                held, count = [], 0
        if held:
            flush()
        for s in range(0, len(best.q), 1 << 16):
            e = s + (1 << 16)
            yield pa.RecordBatch.from_pydict({"query_id": q_ids[best.q[s:e]], "vec_id": best.i[s:e], "score": best.s[s:e]})

    return index.mapInArrow(run, "query_id bigint, vec_id bigint, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _floors(first: DataFrame, q_ids: np.ndarray, k: int) -> np.ndarray:
    """The k-th product of the first pass for each query of a block, minus infinity where there are fewer."""
    got = _top(first, k).where(F.col("rank") == k).select("query_id", "score").toPandas()
    at = dict(zip(got["query_id"].tolist(), got["score"].tolist()))
    return np.array([at.get(i, -np.inf) for i in q_ids.tolist()])


def nearest_by_codes(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    seed: int = 42,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """The k rows of largest inner product for every query row: query_id,
    ``rank`` (from 1), vec_id, ``score``; ties go to the smaller id.

    ``is_query`` is over the column ``id``.  A query's own id is no candidate.
    Rows without id, and vectors that are null, empty, zero or hold null or
    non-finite components, take no part; vectors of different lengths are not
    compared; an id in several rows counts once, with its best score; fewer
    than k candidates are all returned; an empty table gives an empty result.
    Queries go out in blocks of ``query_block``, each broadcast with its
    floors, against all rows; the first pass keeps k rows per query and task,
    the second those that reach the floor.
    """
    every = vectors.select(col(id_col).cast("bigint").alias("id"), col(vector_col).cast("array<double>").alias("v"))
    good = every.where(F.col("id").isNotNull() & usable(F.col("v")))
    parts: list[DataFrame] = []
    for row in good.groupBy(F.size("v").alias("d")).agg(F.count(F.when(is_query, 1)).alias("n")).orderBy("d").collect():
        dim, n = row["d"], row["n"]
        if not n:
            continue
        rows = good.where(F.size("v") == dim)
        centre = _centre(rows, dim)
        index = encode_vectors(rows, dim, centre, seed)
        blocks = -(-n // query_block)
        index = reliable(index)
        for b in range(blocks):
            asked = rows.where(is_query & (F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)).distinct().collect()
            if asked:
                q_ids = np.array([r["id"] for r in asked], np.int64)
                q = np.array([r["v"] for r in asked], dtype=np.float64).reshape(-1, dim)
                floors = _floors(_search(index, q_ids, q, dim, centre, k, seed), q_ids, k)
                parts.append(_search(index, q_ids, q, dim, centre, k, seed, floors))
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    return _top(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
