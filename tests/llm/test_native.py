"""Sharding and mixing: laws, ties, skew, empty and awkward tables."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cases import awkward, empty
from tillrec.llm.mixing import mix_sources, mixed_documents
from tillrec.llm.sharding import shard_by_bytes


def size(t):
    return len((t or "").encode()) + 1


def brute_shards(rows, n_shards):
    """(id, text) rows in digest order; a row goes where the middle of its bytes lies."""
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    order = sorted(rows, key=lambda r: (md5(r[1] or ""), md5("" if r[0] is None else str(r[0])), size(r[1])))
    total, before, out, slots = sum(size(t) for _, t in rows), 0, [], defaultdict(int)
    for i, t in order:
        s = min((2 * before + size(t)) * n_shards // (2 * total), n_shards - 1)
        out.append((i, size(t), zlib.crc32((t or "").encode()), "bytes", s, slots[s], None))
        slots[s] += 1
        before += size(t)
    return sorted(out, key=str)


@pytest.mark.parametrize("rows_per_cell", [1, 3, 4096])
def test_shards_equal_brute_force(spark, rows_per_cell):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i} " * (i % 17)) for i in range(120)] + [(None, None), (5, "text 5 " * 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = sorted(map(tuple, shard_by_bytes(df, 8, rows_per_cell=rows_per_cell).collect()), key=str)
    assert got == brute_shards(rows, 8)


def test_shards_awkward_and_empty(spark):
    out = shard_by_bytes(awkward(spark), 4, carry=True)
    assert out.count() == 12
    assert [c for c in out.columns if c.lower() == "shard"] == ["shard"] and "a.b" in out.columns and "spans" in out.columns
    per = out.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m"), F.countDistinct("slot").alias("d")).collect()
    assert all(r["n"] == r["m"] + 1 == r["d"] for r in per)
    assert shard_by_bytes(empty(spark)).count() == 0


def test_sharding_is_balanced_at_sf001(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    per = shard_by_bytes(docs).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    biggest = max(size(r["text"]) for r in docs.select("text").collect())
    assert len(per) == 8 and max(r["b"] for r in per) - min(r["b"] for r in per) <= 2 * biggest


def water_fill(sizes, weights, share, epochs):
    """Targets by raising the level until the budget is spent."""
    left, budget, target = dict(sizes), share * sum(sizes.values()), {}
    while left:
        level = budget / sum(weights[s] for s in left)
        full = [s for s in left if epochs * sizes[s] <= weights[s] * level]
        if not full:
            return target | {s: weights[s] * level for s in left}
        for s in full:
            target[s] = epochs * sizes[s]
            budget -= target[s]
            del left[s]
    return target


@pytest.mark.parametrize("rows_per_cell", [2, 4096])
def test_mix_targets_and_takes(spark, rows_per_cell):
    rows = [(i, "w " * (1 + i * 7 % 23), ["a", "b", "B", "é", None][min(i % 7, 4)]) for i in range(300)] + [(300, None, "a"), (301, "", "z"), (301, "", "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    out = mix_sources(df, rows_per_cell=rows_per_cell, rows_per_range=50).collect()
    assert len(out) == len(rows)
    source = {i: s for i, _, s in rows}
    sizes = defaultdict(int)
    for i, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    want = water_fill(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5, 2)
    taken = defaultdict(int)
    for r in out:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    assert all(abs(taken[s] - want[s]) <= 2 * 23 for s in sizes)
    again = mix_sources(df.repartition(3), rows_per_cell=rows_per_cell).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_mix_awkward_and_empty(spark):
    assert mix_sources(awkward(spark)).count() == 12
    docs = mixed_documents(awkward(spark).drop("size"))
    assert "a.b" in docs.columns and docs.where("text = ''").count() == 0
    assert mix_sources(empty(spark)).count() == 0 and mixed_documents(empty(spark)).count() == 0
    one = spark.createDataFrame([(1, "a b c", "s")], "doc_id bigint, text string, source string")
    assert mix_sources(one).first()["taken"] == 3  # a second copy would pass the budget
