"""Token counts against the library; decontamination against brute force."""

import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cases import awkward, empty
from tillrec.llm import tokencount as T
from tillrec.llm.decontaminate import Scanner, char_spans, contamination_digest, decontaminated, find_contamination, windows_of, words_of

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def counter():
    with open(PATH, "rb") as f:
        return T.PrefixCounter(f.read())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda s: len(t.encode(s, add_special_tokens=False).ids)


PIECES = ["a", "the", " ", "  ", "\n", "\t", "'s", "'re", "'", "L", "é", "漢", "²", "45", "!", "...", "_", "\x1c", "\x85", "\xa0", "　", "😀", "<|endoftext|>", "<|end", "ing", "\r\n", "'ll", "internationalization"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_every_prefix_equals_the_library(counter, library, text):
    assert T.counts_from_prefix(counter.changes(text)).tolist() == [library(text[:i]) for i in range(len(text) + 1)]


def test_chunks_do_not_matter(counter, library, monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice(PIECES) for _ in range(3000)) + "x" * 500 + "  \n" * 40
    want = counter.changes(text)
    monkeypatch.setattr(T, "CHUNK_CHARS", 17)
    assert counter.changes(text) == want and T.counts_from_prefix(want)[-1] == library(text)


def test_counts_table(spark, library):
    rows = prefix = T.prefix_token_counts(awkward(spark), PATH)
    got = rows.collect()
    assert len(got) == 12 and T.prefix_token_counts(empty(spark), PATH).count() == 0
    texts = sorted((r["text"] or "" for r in awkward(spark).collect()), key=len)
    assert sorted(r["n_tokens"] for r in got) == sorted(library(t) for t in texts)
    budget = T.chars_within_budget(prefix, 5).collect()
    assert all(r["tokens_within"] <= 5 for r in budget)
    by = {r["doc_id"]: r for r in budget}
    text = awkward(spark).where("doc_id = 1").first()["text"]
    n = by[1]["n_chars_within"]
    assert library(text[:n]) <= 5 and all(library(text[:k]) > 5 for k in range(n + 1, len(text) + 1))


@pytest.mark.parametrize("seed", range(5))
def test_scanner_equals_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(100):
        v = [b"a", b"b", b"c"]
        items = [(i, [rng.choice(v) for _ in range(rng.randint(0, 7))]) for i in range(5)]
        doc = [rng.choice([*v, b"x"]) for _ in range(rng.randint(0, 25))]
        hit, own = set(), set()
        for i, w in items:
            for x in windows_of(w, 4):
                for k in range(len(doc) - len(x) + 1):
                    if tuple(doc[k : k + len(x)]) == x:
                        hit |= set(range(k, k + len(x)))
                        own.add(i)
        starts, ends, got = Scanner(items, 4).find(doc)
        assert {k for a, b in zip(starts, ends) for k in range(a, b)} == hit and got == own


def test_words_and_spans():
    assert words_of("Ab1-É_x\x7fZ") == [b"ab1", "É".encode(), b"x", b"z"]
    text = "é, One TWO!! three 漢"
    assert char_spans(text, [(1, 3), (4, 5)]) == [(3, 10), (19, 20)]


def brute(docs, items, window):
    out = []
    for i, t in docs:
        d = words_of(t)
        hit, own = set(), set()
        for k, it in items:
            for x in windows_of(words_of(it), window):
                for a in range(len(d) - len(x) + 1):
                    if tuple(d[a : a + len(x)]) == x:
                        hit |= set(range(a, a + len(x)))
                        own |= {str(k)} - {"None"}
        out.append((i, len(d), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("nodes", [2_000_000, 40])
def test_digest_equals_brute_force(spark, nodes):
    rng = random.Random(1)
    word = lambda: rng.choice(["alpha", "Beta", "gamma,", "δ", "x1"])
    items = [(k, " ".join(word() for _ in range(rng.randint(0, 9)))) for k in range(9)] + [(3, "alpha Beta"), (None, "alpha alpha x1 x1"), (11, None)]
    docs = [(k, " ".join(word() for _ in range(rng.randint(0, 60)))) for k in range(40)] + [(None, None), (90, ""), (90, "")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = find_contamination(d, b, 4, max_nodes=nodes).collect()
    rows = sorted(((r["doc_id"], r["n_words"], r["n_hit"], len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r["n_hit"] > 0) for r in got), key=str)
    assert rows == brute(docs, items, 4)
    text = dict(docs)
    for r in got:
        if r["n_hit"]:
            assert sum(len(words_of(text[r["doc_id"]][s["start"] : s["end"]])) for s in r["spans"]) == r["n_hit"]


def test_decontaminated_keeps_clean_rows(spark):
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog and runs")], "item_id bigint, text string")
    out = decontaminated(awkward(spark), bench)
    assert out.columns == awkward(spark).columns and out.count() == 10
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminated(awkward(spark), none).count() == 12
    assert contamination_digest(empty(spark).drop("items", "spans"), bench).count() == 0
