"""Source divergence and line rules against brute force in plain integers."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cases import awkward, empty
from tillrec.llm import divergence as D
from tillrec.llm import linerules as L

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute_divergence(rows, min_docs=3, top=200):
    docs = [(la or "", s or "", Counter(TERM.findall(lower(t or "")))) for t, la, s in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for _, _, c in mine for t in c)
        kept = sorted(t for t, n in df.items() if n >= min_docs)
        v = len(kept)
        count = defaultdict(Counter)
        for _, s, c in mine:
            count[s].update({t: n for t, n in c.items() if df[t] >= min_docs})
            count[s] += Counter()
        every = sum(count.values(), Counter())

        def p(c):
            total = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 1) // (total + v) for t in kept}

        ps, pl = {s: p(c) for s, c in count.items()}, p(every)
        f = lambda a, b: (a - b) ** 2 // b
        for s in ps:
            pair = sorted(((-sum(f(ps[s][t], ps[o][t]) for t in kept), o) for o in ps if o != s), key=lambda x: (x[0], x[1].encode()))
            out += [(lang, s, "pair", o, -x, k + 1) for k, (x, o) in enumerate(pair)]
            term = sorted(((-f(ps[s][t], pl[t]), t) for t in kept if count[s][t] and ps[s][t] > pl[t]), key=lambda x: (x[0], x[1].encode()))
            out += [(lang, s, "term", t, -x, k + 1) for k, (x, t) in enumerate(term[:top])]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"list_size": 2, "block": 2, "entries": 5}])
def test_divergence_equals_brute_force(spark, options):
    """Small lists, blocks and counters force every way of splitting."""
    rnd = random.Random(4)
    words = ["Alpha", "beta", "Éclair", "delta-x", "é", "z9z", "漢字", "omega", "PI"]
    texts = [" ".join(rnd.choice(words[: rnd.randint(2, 9)]) for _ in range(rnd.randint(0, 30))) for _ in range(25)]
    rows = [(rnd.choice(texts), rnd.choice(["en", "de", None]), rnd.choice(["a", "b", "c", "d", "e", None])) for _ in range(300)]
    rows += [("", "en", "quiet"), (None, "fr", "x"), ("once only", "fr", "y"), ("solo solo solo", "it", "z")] + [(texts[0], "en", "a")] * 60
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("value", F.lit("clash")).repartition(4)
    got = sorted(tuple(r) for r in D.source_divergence(df, top=5, **options).collect())
    assert got == brute_divergence(rows, top=5)


def test_divergence_awkward_and_empty(spark):
    docs = awkward(spark)
    rows = [(r["text"], r["lang"], r["source"]) for r in docs.collect()]
    assert sorted(tuple(r) for r in D.source_divergence(docs).collect()) == brute_divergence(rows)
    assert D.source_divergence(empty(spark)).count() == 0


def test_probabilities_are_exact_for_large_counts(spark):
    cases = [(0, 1, 1), (10**9, 10**9, 7), (123_456_789_012, 250_000_000_000_000, 10**7), (0, 0, 5), (249_999_999_999_999, 250_000_000_000_000, 3)]
    df = spark.createDataFrame(cases, "n bigint, total bigint, words bigint")
    got = [r["p"] for r in df.select(D.probability("n", "total", "words").alias("p")).collect()]
    assert got == [1 + 10**9 * (n + 1) // (t + w) for n, t, w in cases]


def brute_lines(rows, min_docs=10, share=0.001, min_words=50, min_left=50):
    norm = lambda t: [x for x in (re.sub("[0-9]+", "0", re.sub("[\x20\x09\x0b-\x0d]+", " ", (t or "").lower())).split("\n"))]
    lines = lambda t: [x.strip(" ") for x in norm(t) if x.strip(" ")]
    texts = {(h, t or "") for _, t, h in rows}
    held = Counter((h, x) for h, t in texts for x in {*lines(t)})
    size = Counter(h for h, _ in texts)
    out = []
    for i, t, h in rows:
        t = t or ""
        w = WORD.findall(t)
        g = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        many = Counter(g)
        rep = {p for k, x in enumerate(g) if many[x] > 1 for p in range(k, k + 3)}
        raw = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < min_words or 2 * len(rep) > len(w)
        gone = [x for x in lines(t) if held[h, x] > max(min_docs, share * size[h])]
        left = len(w) - sum(len(x.split(" ")) for x in gone)
        out.append((i, len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(raw) - len({*raw}), len(rep), failed,
                    left, not failed and left >= min_words and 100 * left >= min_left * len(w)))
    return sorted(out, key=str)


def line_rows():
    rnd = random.Random(6)
    words = [f"w{k}" for k in range(400)]
    line = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    own = [line(12) for _ in range(200)]
    boiler = ["Subscribe to our NEWS  letter 123 now", "All rights reserved 2024", line(40)]
    rows = []
    for i in range(150):
        parts = [rnd.choice(own) for _ in range(rnd.randint(1, 12))] + rnd.sample(boiler, rnd.randint(0, 3))
        if i % 10 == 0:
            parts = [boiler[2], "#* a|b", "a b c a b c", ""]
        rnd.shuffle(parts)
        t = "\n".join(parts).replace("123", str(i))
        rows += [(i, t, rnd.choice(["h1", "h1", "h2", None]))] * (40 if i == 3 else 1)
    return rows + [(200, None, "h1"), (201, "", None), (202, " \n\t", "h2"), (203, "a b c " * 30, "h1"), (204, "x y z " + line(60) + " x y z", "h1"), (205, "é " * 60, "h3")]


@pytest.mark.parametrize("hot_rows", [10_000, 2])
def test_line_rules_equal_brute_force(spark, hot_rows):
    """A small ``hot_rows`` sends frequent lines and copied texts the way of the hot ones."""
    rows = line_rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("kept", F.lit("clash")).repartition(4)
    got = sorted((tuple(r) for r in L.line_rules(df, hot_rows=hot_rows).collect()), key=str)
    assert got == brute_lines(rows)
    assert any(not r[6] and not r[8] for r in got) and any(r[8] for r in got)


def test_cleaned_text_lacks_the_frequent_lines(spark):
    rows = line_rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("kept", F.lit("clash"))
    got = L.line_rules(df, carry=True).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() >= {"doc_id", "text", "source", "cleaned", "kept"}
    for r in got:
        assert len(WORD.findall(r["cleaned"])) == r["n_left"]
        left = r["cleaned"].split("\n") if r["cleaned"] else []
        assert all(x in (r["text"] or "").split("\n") for x in left)


def test_line_rules_awkward_and_empty(spark):
    docs = awkward(spark)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    assert sorted((tuple(r) for r in L.line_rules(docs).collect()), key=str) == brute_lines(rows)
    assert L.line_rules(empty(spark)).count() == 0 and L.line_rules(docs, carry=True).count() == 12
