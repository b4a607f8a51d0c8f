"""SimHash components, repeated byte strings and nearest neighbours against brute force."""

import hashlib
import random
import re
from functools import reduce
from operator import add

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cases import awkward, empty
from tillrec.llm import ann, pfp
from tillrec.llm import simhash as S


def brute_fingerprint(t, k=4):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    w = re.findall("[^\x20\x09-\x0d]+", t)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(k) for k in range(len(fps))]


def test_fingerprints(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "B", "é", "cc", "\n", "İ", ""]) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    want = [brute_fingerprint(t) for t in texts]
    assert [S.fingerprint(t) for t in texts] == want
    monkeypatch.setattr(S, "BLOCK_BYTES", 11)
    monkeypatch.setattr(S, "BLOCK_SHINGLES", 3)
    assert [S.fingerprint(t) for t in texts] == want


@pytest.mark.parametrize("radius", [1, 3, 4])
def test_masks_cover_every_pair_within_the_radius(radius):
    masks, rng = S.covering_masks(radius), random.Random(radius)
    for _ in range(3000):
        diff = sum(1 << i for i in rng.sample(range(64), rng.randint(0, radius)))
        assert any(not diff & m for m in masks)


@pytest.mark.parametrize("bucket_rows", [3, 2048])
def test_links_give_all_components(spark, bucket_rows):
    rng, fps = random.Random(5), set()
    for _ in range(25):
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 25)):
            fps.add(f)
            f ^= sum(1 << i for i in rng.sample(range(64), rng.randint(1, 5)))
    fps = sorted(S._signed(f) for f in fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    got = {r["node"]: r["root"] for r in S.components(S.links(df, 4, bucket_rows)).collect()}
    want = brute_components([f & (1 << 64) - 1 for f in fps], 4)
    assert [got.get(f, f) for f in fps] == [fps[k] for k in want]


def test_simhash_table(spark):
    docs = awkward(spark)
    got = S.simhash_components(docs).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    fps = [brute_fingerprint(t) for _, t in rows]
    comp = brute_components(fps, 4)
    low = {c: min((i for (i, _), d in zip(rows, comp) if d == c and i is not None), default=None) for c in comp}
    assert sorted((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got if r["doc_id"]) == sorted((i, f, low[c]) for (i, _), f, c in zip(rows, fps, comp) if i)
    assert len(got) == 12
    kept = S.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(comp))
    assert S.simhash_digest(empty(spark)).count() == 0 and S.one_of_each(empty(spark)).count() == 0


def brute_repeats(docs, span):
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for k in range(len(b) - span + 1):
            if i is not None:
                first[b[k : k + span]] = min(first.get(b[k : k + span], i), i)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 2, int)
        for k in range(len(b) - span + 1):
            if i is not None and first[b[k : k + span]] < i:
                gone[k + 1 : k + 1 + span] = 1
        kept = bytes(c for c, x in zip(b, gone[1:]) if not x)
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("crowd, common, flush, sort", [(4096, 0.02, 4 << 20, 1 << 20), (2, 0.0005, 700, 50)])
def test_repeats_equal_brute_force(spark, monkeypatch, crowd, common, flush, sort):
    monkeypatch.setattr(pfp, "CROWD", crowd)
    monkeypatch.setattr(pfp, "COMMON_SHARE", common)
    monkeypatch.setattr(pfp, "FLUSH_TEXT", flush)
    monkeypatch.setattr(pfp, "SORT_WINDOWS", sort)
    rng = random.Random(crowd)
    words = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 9))) for _ in range(12)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(10)]
    docs = []
    for i in range(60):
        t = rng.choice(base)
        if t and rng.random() < 0.6:
            k = rng.randrange(len(t))
            t = t[:k] + rng.choice(["X", "", "yy"]) + t[k + 1 :]
        t = "xy " * rng.randint(1, 90) if rng.random() < 0.2 else t
        docs.append((rng.choice([i, i, i, 5, None]), rng.choice([t, t, t, t, None])))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    out = pfp.remove_repeats(df, keep_text=True).collect()
    assert sorted((tuple(r)[:5] for r in out), key=str) == brute_repeats(docs, 50)
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in out)


def test_parse_covers_every_window_with_its_trigger():
    rng = np.random.default_rng(0)
    lengths = np.array([0, 300, 49, 50, 0, 1000, 10])
    data = rng.integers(97, 100, lengths.sum()).astype(np.uint8)
    data[350:600] = 120  # one long run of one letter
    seg, start, size, trigger, _ = pfp.parse(data, lengths, 50, 20)
    got = sorted((int(s), int(a) + k) for s, a, n in zip(seg, start, size) for k in range(n))
    assert got == [(s, k) for s, n in enumerate(lengths) for k in range(n - 49)]


def test_repeats_awkward_and_empty(spark):
    got = sorted((tuple(r) for r in pfp.remove_repeats(awkward(spark)).collect()), key=str)
    assert got == brute_repeats([(r["doc_id"], r["text"]) for r in awkward(spark).collect()], 50)
    assert pfp.remove_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize("block", [(8192, 20), (64, 1)])
def test_nearest_equals_brute_force(spark, monkeypatch, block):
    """Exact ids, ranks and scores, with groups of equal vectors dealt over several tasks and row blocks."""
    monkeypatch.setattr(ann, "ROW_BLOCK", block[0])
    rng = np.random.default_rng(1)
    x = rng.standard_normal((700, 24)).astype("f4") + 0.5
    x[100:140] = x[3]
    x[::7] = x[1]
    x[401:405] = x[400] * 2
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1020, []), (1040, [0.0] * 24), (1060, [float("nan")] * 24), (1080, [None] * 24), (None, x[0].tolist()), (1100, [1.0, 2.0]), (1120, [2.0, 1.0]), (5, x[5].tolist())]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>").withColumn("score", F.lit("clash")).repartition(4)
    got = ann.nearest_by_codes(df, F.col("id") % 20 == 0, k=20, query_block=block[1]).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(by) == [*range(0, 700, 20), 1100, 1120] and by[1100] == [(1, 1120, 4.0)]
    d = x.astype("f8")
    for q in range(0, 700, 20):
        s = [reduce(add, (a * b for a, b in zip(v.tolist(), d[q].tolist()))) for v in d]  # sum() would correct its rounding
        want = sorted((i for i in range(700) if i != q), key=lambda i: (-s[i], i))[:20]
        assert sorted(by[q]) == [(k + 1, i, s[i]) for k, i in enumerate(want)]
    assert ann.nearest_by_codes(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_codes_and_bounds():
    rng = np.random.default_rng(2)
    x, q = rng.standard_normal((2000, 64)), rng.standard_normal(64)
    turn = ann.rotation(64, 42)
    wide = 64 * ann.WIDER
    assert turn.shape == (wide, 64) and np.allclose(turn.T @ turn, np.eye(64))
    bits, norm, align = ann.encode(x, np.zeros(64), turn)
    assert bits.shape == (2000, wide // 8)
    est = norm / (align * np.sqrt(wide)) * ((np.unpackbits(bits, axis=1) * 2.0 - 1) @ (turn @ q))
    err = norm * np.linalg.norm(q) * np.sqrt(1 - align**2) / align * ann.EPSILON / np.sqrt(wide - 1)
    assert (np.abs(est - x @ q) <= err).mean() > 0.999


def passes(x, q, k):
    """Both passes over one block of rows: what the second found, pairs reranked."""
    dim = x.shape[1]
    turn, centre, ids = ann.rotation(dim, 42), x.mean(axis=0), np.arange(len(x))
    bits, norm, align = ann.encode(x, centre, turn)
    q_norm = np.linalg.norm(q, axis=1)
    best, reranked, floors = None, 0, None
    for _ in range(2):
        best = ann.Best(len(q), k)
        for s in range(0, len(x), ann.ROW_BLOCK):
            e = s + ann.ROW_BLOCK
            reranked += ann.search_block(best, -1 - np.arange(len(q)), q, (q / q_norm[:, None] @ turn.T).astype("f4"), q_norm,
                                         q / q_norm[:, None] @ centre, ids[s:e], x[s:e], bits[s:e], norm[s:e], align[s:e], k, floors)
        floors = best.floor
    return best, reranked


def test_codes_leave_few_pairs_to_the_exact_product():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((20_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q = x[:200] + 0.05 * rng.standard_normal((200, 64))
    best, reranked = passes(x, q, 20)
    hits = sum(len({*np.argsort(-(x @ v), kind="stable")[:20].tolist()} & {*best.i[best.q == n].tolist()}) for n, v in enumerate(q))
    assert hits >= 0.9995 * 20 * 200 and reranked < 0.1 * x.shape[0] * len(q)


def test_bound_holds_where_near_copies_crowd_the_best_estimates():
    rng = np.random.default_rng(3)
    dim, k = 32, 20
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    a = unit(rng.standard_normal(dim))
    x = np.concatenate([a + 1e-4 * rng.standard_normal((4000, dim)), unit(rng.standard_normal((4000, dim)))])
    across = rng.standard_normal((400, dim))
    q = 0.46 * a + 0.89 * unit(across - (across @ a)[:, None] * a)
    best, _ = passes(x, q, k)
    hits = sum(len({*np.argsort(-(x @ v), kind="stable")[:k].tolist()} & {*best.i[best.q == n].tolist()}) for n, v in enumerate(q))
    assert hits >= 0.9995 * k * len(q)
