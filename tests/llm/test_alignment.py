"""Tokenizer alignment against whole-text encoding, token by token."""

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cases import awkward, empty
from tillrec.llm import alignment as AL
from tillrec.llm.queries import SECOND_VOCABULARY, vocabulary_path
from tillrec.llm.tokencount import byte_letters

FIRST, SECOND = vocabulary_path(), vocabulary_path(SECOND_VOCABULARY)
A = Tokenizer.from_file(FIRST)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=SECOND)
LETTERS = byte_letters()
BYTES_A = {i: bytes(LETTERS[c] for c in t) for t, i in A.get_vocab().items()}
ODD = [
    "a  é 漢😀\x07b<s> </s><unk>  x  y", "▁", "a▁b c", " ", "\n", "  \n\t x", "a\r\nb ;\r\n c\t\td", "don't  we'll\n\n\nstop  ",
    "<|endoftext|> <s> ", "한국어 텍스트 日本語テキスト", "​﻿\xa0 　x", "é ﬁ ½ ２", "\x00\x01", "a" * 3000, "😀" * 50, "\x1c a\x85 b  c", "� x",
]


def whole(text):
    """Ids of both tokenizers and their byte ends from one encoding of the whole text."""
    if not text:
        return None
    want = (" " + text).encode()
    a = A.encode(" " + text, add_special_tokens=False).ids
    b = B.encode(text)
    pa = [BYTES_A[i] for i in a]
    pb = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(pa) != want or b"".join(pb) != want:
        return None
    ends = lambda parts: [sum(map(len, parts[: k + 1])) for k in range(len(parts))]
    return a, ends(pa), b, ends(pb)


def brute(texts):
    links, out = Counter(), []
    for t in texts:
        got = whole(t)
        if got is None:
            out.append((0, 0, 0, [], ""))
            continue
        a, ea, b, eb = got
        groups, mine, i, j = [], [], 0, 0
        for cut in sorted({*ea} & {*eb}):
            k, m = ea.index(cut) + 1, eb.index(cut) + 1
            groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
            mine.append((a[k - 1], b[m - 1]))
            i, j = k, m
        links.update(mine)
        out.append((len(a), len(b), len(groups), mine, ";".join(groups)))
    top = Counter()
    for (_, y), n in links.items():
        top[y] = max(top[y], n)
    return [
        (na, nb, ng, ng, sum(links[p] == top[p[1]] for p in mine), sum(links[p] for p in mine), hashlib.sha256(g.encode()).hexdigest() if g else "", g)
        for na, nb, ng, mine, g in out
    ]


def check(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("n_a", F.lit("clash")).repartition(3)
    got = AL.align_tokenizers(df, FIRST, SECOND, keep_groups=True, **options).orderBy("doc_id").collect()
    for t, r, want in zip(texts, got, brute(texts)):
        assert tuple(r)[1:] == want, repr(t)[:80]


@pytest.mark.parametrize("options", [{}, {"memo_units": 3, "pairs_per_block": 11}])
def test_groups_and_counts_equal_whole_encoding(spark, options):
    rnd = random.Random(3)
    pieces = ["the", " ", "\n", "é", "漢字", "'s", "12", ".", "  ", "Wörter", "\t", "😀", "don't", "\r\n", "x", "­"]
    texts = ODD + [None, ""] + ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 60))) for _ in range(60)]
    check(spark, texts + texts[-20:], **options)


def test_whole_texts_where_units_do_not_hold(monkeypatch):
    with open(FIRST, "rb") as f, open(SECOND, "rb") as g:
        al = AL.Aligner(f.read(), g.read())
    assert al.units_hold
    texts = ODD + ["some words here, and\nthere"]
    in_units = al.texts(texts)
    al.memo, al.older, al.units_hold = {}, {}, False
    assert al.texts(texts) == in_units


def test_a_small_memo_gives_the_same():
    with open(FIRST, "rb") as f, open(SECOND, "rb") as g:
        files = f.read(), g.read()
    texts = [" ".join(f"w{k * j}" for j in range(30)) for k in range(20)]
    assert AL.Aligner(*files, memo_units=1, call_bytes=10).texts(texts) == AL.Aligner(*files).texts(texts)


def test_awkward_and_empty(spark):
    docs = awkward(spark)
    got = sorted((tuple(r)[:5] for r in AL.align_tokenizers(docs, FIRST, SECOND).collect()), key=str)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted(((i, *w[:4]) for (i, _), w in zip(rows, brute([t for _, t in rows]))), key=str)
    assert got == want
    assert AL.align_tokenizers(empty(spark), FIRST, SECOND).count() == 0
