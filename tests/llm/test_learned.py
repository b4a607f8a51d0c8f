"""Networks and classifiers: gradients, decoding, held-out accuracy, awkward tables."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import awkward, empty
from tillrec.llm import langid, pii, quality
from tillrec.llm import recurrent as R

SF01 = "/root/testdata/sf0.01"


@pytest.mark.parametrize("cell", ["gru", "lstm"])
def test_gradients_through_time(cell, monkeypatch):
    rng = np.random.default_rng(0)
    p = {k: v.astype("f8") for k, v in R.fresh(cell, 5, 3, 4, 1).items()}
    x, n, y = rng.integers(0, 5, (3, 6)).astype("u1"), np.array([6, 4, 1]), rng.integers(0, 4, 3)

    def value(p):
        s = np.moveaxis(R.outputs({k: v.astype("f4") for k, v in p.items()}, cell, np.ascontiguousarray(x.T), n), 1, 2).astype("f8")
        prob = np.exp(s) / np.exp(s).sum(axis=2, keepdims=True)
        return -(np.log(prob[:, np.arange(3), y]) * (np.arange(6)[:, None] < n)).sum()

    def loss(p, s, pick):
        prob = np.exp(s) / np.exp(s).sum(axis=2, keepdims=True)
        prob[:, np.arange(len(pick)), y[pick]] -= 1
        return 0.0, prob * (np.arange(len(s))[:, None] < n[pick])[:, :, None], {}

    found, real = [], R._through_time

    def spy(*a):
        found.extend(real(*a))
        return found[-2], found[-1]

    monkeypatch.setattr(R, "_through_time", spy)
    R.train({k: v.copy() for k, v in p.items()}, cell, x, n, loss, 1, 3, 1e-9, 0)  # one step
    grads = dict(zip(("ef", "uf", "eb", "ub"), found))
    for k in ("ef", "uf", "eb", "ub"):
        for _ in range(4):
            i = tuple(rng.integers(0, s) for s in p[k].shape)
            up, down = ({a: b.copy() for a, b in p.items()} for _ in range(2))
            up[k][i] += 1e-2
            down[k][i] -= 1e-2
            assert abs((value(up) - value(down)) / 2e-2 - grads[k][i]) < 5e-2


def test_windows_own_every_position_once():
    for n in (0, 1, 9, 10, 11, 57):
        own = [k for _, _, a, b in R.windows(n, 10, 4) for k in range(a, b)]
        assert own == list(range(n)) and all(s <= a and b <= e for s, e, a, b in R.windows(n, 10, 4))


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    got = langid.identify_languages(docs)
    both = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert both.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    # the label, source and id of a row say nothing to its prediction
    changed = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("?"))
    assert sorted(map(str, langid.identify_languages(changed).collect())) == sorted(map(str, got.collect()))


def test_language_sample_counts_copies_once(spark):
    few = F.concat(F.lit("kopie "), (F.col("id") % 5).cast("string"))
    docs = spark.range(20_000).select(F.lit("xx").alias("lang"), few.alias("text"))
    docs = docs.union(spark.range(4_000).select(F.lit("yy").alias("lang"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")))
    got = langid.training_windows(docs)
    assert [t for lang, t in got if lang == "xx"] == [f"kopie {k}" for k in range(5)]
    assert len({t for lang, t in got if lang == "yy"}) == langid.DOCS_PER_LANG


def test_language_awkward(spark):
    got = langid.identify_languages(awkward(spark)).collect()
    assert len(got) == 12 and langid.identify_languages(empty(spark)).count() == 0
    for r in got:
        assert 0 <= r["score"] <= 1
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert by[3] == by[4] == by[5] == by[9] == "und" and by[1] != "und"
    none = langid.identify_languages(awkward(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def direct_spans(t):
    out = []
    for k, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            ok = [True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 16 <= len(d) <= 19 and pii.luhn(d), 8 <= len(d) <= 15][k]
            if ok:
                out.append((k, m.start(), m.end()))
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(5)
    parts = ["a", "@", ".", "1", "25", "300", "-", " ", "+", "(", "é", "4111111111111111", "a@b.c", "0001"]
    for _ in range(5000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(t) == direct_spans(t)
    assert pii.base_spans("1" * 200_000 + "a" * 200_000) == []  # linear time


def test_crf_loss_and_decoding():
    rng = np.random.default_rng(0)
    k, n = 4, np.array([5, 3, 1])
    trans, s, y = rng.standard_normal((k, k)), rng.standard_normal((5, 3, k)), rng.integers(0, k, (5, 3))

    def path_score(trans, s, b, path):
        return sum(s[t, b, c] for t, c in enumerate(path)) + sum(trans[a, c] for a, c in zip(path, path[1:]))

    def brute(trans, s):
        total = 0.0
        for b in range(3):
            z = np.array([path_score(trans, s, b, path) for path in itertools.product(range(k), repeat=n[b])])
            total += np.log(np.exp(z).sum()) - path_score(trans, s, b, y[: n[b], b].tolist())
        return total / n.sum()

    value, ds, dt = pii.crf_loss(trans, s, y, n)
    assert abs(value - brute(trans, s)) < 1e-9
    for _ in range(6):
        i, j = tuple(rng.integers(0, m) for m in s.shape), tuple(rng.integers(0, k, 2))
        e, f = np.zeros_like(s), np.zeros_like(trans)
        e[i] = f[j] = 1e-4
        assert abs((brute(trans, s + e) - brute(trans, s - e)) / 2e-4 * 20 - ds[i]) < 1e-5
        assert abs((brute(trans + f, s) - brute(trans - f, s)) / 2e-4 * 20 - dt[j]) < 1e-5
    tags = pii.viterbi(trans, np.moveaxis(s, 2, 1), n)
    for b in range(3):
        best = max(itertools.product(range(k), repeat=n[b]), key=lambda path: path_score(trans, s, b, path))
        assert tuple(tags[: n[b], b]) == best


def test_skipping_decoding_changes_nothing(monkeypatch):
    p = R.fresh("lstm", pii.SYMBOLS, 4, 5, 3) | {"trans": np.random.default_rng(1).standard_normal((5, 5)).astype("f4") * 0.3}
    p["bias"][0] = 1.0
    rng = np.random.default_rng(2)
    seqs = [rng.integers(0, 128, n).astype("u1") for n in (0, 1, 700, 1300, 40)]
    got = pii.tagged(p, seqs)
    wide = dict(p)
    real = pii.viterbi
    monkeypatch.setattr(pii, "viterbi", lambda trans, s, n: real(p["trans"], s, n))
    wide["trans"] = p["trans"] + np.eye(5, dtype="f4") * 0 + np.where(np.arange(25).reshape(5, 5) == 24, 1e6, 0).astype("f4")  # no window is skipped
    all_ = pii.tagged(wide, seqs)
    assert got.keys() == all_.keys() and all((got[k] == all_[k]).all() for k in got)


def test_pii_sample_counts_copies_once(spark, monkeypatch):
    number = F.when(F.col("id") < 9000, F.col("id") % 3).otherwise(F.col("id"))
    docs = spark.range(9200).select(F.concat(F.lit("call "), number.cast("string")).alias("text"))
    monkeypatch.setattr(pii, "SAMPLE_DOCS", 150)  # fewer than rows, and 203 texts: no thinning
    got = pii.training_windows(docs)
    assert sorted(got) == sorted(2 * [f"call {k}" for k in [0, 1, 2, *range(9000, 9200)]])
    monkeypatch.setattr(pii, "SIGN_WINDOWS", 20)
    monkeypatch.setattr(pii, "PLAIN_WINDOWS", 20)
    got = pii.training_windows(docs)
    assert len(got) == 40 and set(got[:20]) != set(got[20:])


def test_language_sample_is_the_same_without_a_broadcast(spark, monkeypatch):
    labelled = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang is not null and text is not null").select("lang", "text")
    small = langid.training_windows(labelled)
    monkeypatch.setattr(langid, "MAX_LANGS", 1)
    assert langid.training_windows(labelled) == small and small


def held_out(texts, spelling, seed):
    """Texts with one number written in at a blank, and where it stands."""
    rng, out = np.random.default_rng(seed), []
    for t in texts:
        at = t.find(" ", int(rng.integers(0, max(1, len(t) - 5))))
        at = len(t) if at < 0 else at
        s = spelling.format(pii._number(rng, 3), pii._number(rng, 3), pii._number(rng, 4))
        out.append((t[:at] + " " + s + t[at:], (3, at + 1, at + 1 + len(s))))
    return out


@pytest.fixture(scope="module")
def fitted_pii(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    train = docs.where("doc_id % 2 = 0").select("text")
    texts = [r["text"] for r in docs.where("doc_id % 2 = 1 and length(text) > 0").orderBy("doc_id").collect()]
    return pii.fit(pii.labelled(pii.training_windows(train), 42), 42), texts


@pytest.mark.parametrize("spelling", pii.SPELLINGS)
def test_network_finds_each_spelling_in_held_out_texts(fitted_pii, spelling):
    p, texts = fitted_pii
    cases = held_out([t[:3000] for t in texts[:200]], spelling, 7)
    tags = pii.tagged(p, [pii.symbols(t) for t, _ in cases])
    found = [pii.added_spans(t, tags[k], pii.base_spans(t)) if k in tags else [] for k, (t, _) in enumerate(cases)]
    assert sum(span in f for f, (_, span) in zip(found, cases)) >= 0.9 * len(cases)


def test_network_adds_little_else(fitted_pii):
    p, texts = fitted_pii
    tags = pii.tagged(p, [pii.symbols(t) for t in texts])
    more = [s for k in tags for s in pii.added_spans(texts[k], tags[k], pii.base_spans(texts[k]))]
    assert len(more) <= 0.01 * len(texts)


def test_windows_left_out_of_decoding_have_no_tag(fitted_pii):
    """The bound against decoding every window, with the fitted weights and with ones that tag a lot."""
    p, texts = fitted_pii
    some = [pii.symbols(t) for t, _ in held_out(texts[:60], "{}-{}-{}", 3)] + [pii.symbols(t) for t in texts[60:120]]
    loose = p | {"trans": p["trans"] * 0.2, "bias": p["bias"] + np.float32([0, 1.5, 1, 1, 2])}
    for q in (p, loose):
        n_out = n_all = 0
        for rows, x, n in pii.R.lanes(some, pii.SIZE, pii.OVERLAP):
            s = pii.R.outputs(q, "lstm", x, n)
            out = ~pii.may_leave(q["trans"], s, n)
            tags = pii.viterbi(q["trans"], s, n)
            assert not tags[:, out].any()
            n_out, n_all = n_out + int(out.sum()), n_all + len(n)
        if q is p:
            assert n_out > 0.5 * n_all


def test_one_position_windows_and_bounds():
    trans = np.zeros((5, 5), np.float32)
    s = np.zeros((3, 5, 4), np.float32)
    s[0, 1, 0] = 1  # gains at its only position
    s[:, 2, 1] = [-1, 3, -1]
    s[:, 1:, 2] = -1
    s[:, 1:, 3] = -1
    s[2, 1, 3] = 5  # behind the end of its lane
    n = np.array([1, 3, 3, 2])
    got = pii.may_leave(trans, s, n)
    assert got.tolist() == [True, True, False, False]
    assert (pii.viterbi(trans, s, n)[:, ~got] == 0).all()


def test_pii_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(awkward(spark).select(F.col("doc_id") + 5000, "text").toDF("doc_id", "text"))
    extra = [(10_000 + k, f"call ({k}12) 555-1234 or card 12 4111111111111111 now, see 2024") for k in range(1, 9)]
    docs = docs.union(spark.createDataFrame(extra, "doc_id bigint, text string"))
    got = {(r["doc_id"], r["text"] or ""): r["spans"] for r in pii.find_pii(docs).join(docs, "doc_id").collect()}
    for (_, t), spans in got.items():
        assert [(pii.KINDS.index(s["kind"]), s["start"], s["end"]) for s in spans if s["base"]] == direct_spans(t)
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s["kind"]), s["start"]))
        for s in spans:
            assert s["base"] or pii.plausible(pii.KINDS.index(s["kind"]), t, s["start"], s["end"])
    assert pii.pii_digest(empty(spark)).count() == 0


def test_quality_learns_both_targets(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_documents(docs, labels).join(labels.withColumnRenamed("quality", "is_good").withColumnRenamed("toxic", "is_toxic"), "doc_id")
    r = got.agg(F.avg(F.when((F.col("is_good") == 0), F.col("keep").cast("int"))).alias("junk"), F.avg(F.when((F.col("is_good") == 1) & (F.col("is_toxic") == 0), F.col("keep").cast("int"))).alias("clean")).first()
    assert r["junk"] < 0.1 and r["clean"] > 0.97


def test_cotraining_passes_labels_between_the_views():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 600)
    words = [np.array([int(v)]) if rng.random() < 0.9 else np.array([2]) for v in y]
    meta = np.zeros((600, quality.N_META))
    meta[:, 0] = y * 2.0 + rng.normal(0, 0.4, 600)
    known = np.where(np.arange(600) < 24, 1, np.where(np.arange(600) < 80, 2, 0))
    model = quality.cotrain(words, meta, y.astype(float), known, 3)
    p = np.array([quality.apply(model, w, m)[2] for w, m in zip(words, meta)])
    assert ((p > 0.5) == y)[80:].mean() > 0.95


def test_rare_class_of_labels_is_learned(spark):
    """One toxic document in a thousand: all of its labels are looked at, and toxic documents outside the labels are found."""
    n = 24_000
    i = F.col("id")
    toxic = i % 1000 == 7
    words = F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), F.pmod(F.xxhash64(i, F.lit(k)), F.lit(50)).cast("string")) for k in range(12)])
    docs = spark.range(n).select(
        i.alias("doc_id"), F.when(toxic, F.concat(words, F.lit(" vile foul rotten"))).otherwise(words).alias("text"),
        F.lit("s").alias("source"), F.lit("en").alias("lang"), toxic.alias("bad"))
    labels = docs.where("doc_id % 5 < 4").select("doc_id", F.lit(1).alias("quality"), F.col("bad").cast("int").alias("toxic"))
    r = quality.score_documents(docs, labels).join(docs, "doc_id").groupBy("bad").agg(F.avg(F.col("keep").cast("int")).alias("kept")).collect()
    kept = {x["bad"]: x["kept"] for x in r}
    assert kept[True] < 0.1 and kept[False] > 0.995


def test_quality_with_one_id_for_most_rows(spark, monkeypatch):
    monkeypatch.setattr(quality, "UNLABELLED", 50)
    docs = spark.range(3000).select(
        F.when(F.col("id") < 2500, F.lit(None)).otherwise(F.col("id") % 3).cast("bigint").alias("doc_id"),
        F.concat(F.lit("text "), (F.col("id") % 40).cast("string")).alias("text"), F.lit("s").alias("source"), F.lit("en").alias("lang"))
    labels = spark.createDataFrame([(k % 3, k % 2, 0) for k in range(30)], "doc_id bigint, quality int, toxic int")
    assert quality.score_documents(docs, labels).count() == 3000


def test_quality_awkward(spark):
    labels = spark.createDataFrame([(1, 1, 0), (8, 0, None), (None, 1, 1), (7, 0, 1), (7, 0, 1), (99, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.score_documents(awkward(spark), labels)
    assert got.count() == 12
    assert quality.score_documents(empty(spark), labels).count() == 0
    kept = quality.good_documents(awkward(spark), labels.limit(0))
    assert kept.columns == awkward(spark).columns and kept.count() == 12  # nothing is learned: all stay
