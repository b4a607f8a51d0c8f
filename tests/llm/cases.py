"""Awkward rows that every operator must take."""

LONG = "lorem ipsum dolor sit amet consectetur " * 4000
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "size int, shard string, spans string, items int, fp string, prefix string, `a.b` int"
)


def rows():
    base = [
        (1, "The quick brown fox jumps over the lazy dog and runs away", "en", "a"),
        (2, "The quick brown fox jumps over the lazy dog and runs away", "en", "a"),
        (3, None, "en", "a"),
        (4, "", None, "b"),
        (5, "   \n\t ", "de", None),
        (None, "no id but some words here", "de", None),
        (6, LONG, None, "c"),
        (7, "Ein kurzer Text über nichts: a@b.de, 10.0.0.1, +49 (030) 555-1234", "de", "b"),
        (7, "Ein kurzer Text über nichts: a@b.de, 10.0.0.1, +49 (030) 555-1234", "de", "b"),
        (8, "x", "en", "c"),
        (9, None, None, None),
        (10, "漢字 かな 😀 é ß", "ja", "d"),
    ]
    return [(i, t, la, s, len(t or ""), 1, "s", "p", 2, "f", "q", 3) for i, t, la, s in base]


def awkward(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
