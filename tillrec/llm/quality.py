"""Document quality by co-training.

Two logistic classifiers see a document from two sides: its words and signs
(content), and what is known of the page without reading it (source,
language, lengths, line and character statistics: metadata).  Starting from
labelled documents, each side in turn labels the unlabelled ones of which it
is sure, for the other side to learn from.  After the rounds each side is
calibrated on labelled documents kept apart, and a logistic combination of
both scores every document.  Quality and toxicity are two such targets.
"""

from __future__ import annotations

import re
import zlib
from operator import eq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillrec.llm.common import col, map_rows, reliable

#: Bounds of the training sample: labelled documents (a class of labels that its share
#: would leave with less gets up to a twelfth of them on top) and distinct unlabelled texts.
LABELLED, UNLABELLED = 6000, 3000
#: Content features of a target: at most so many words, each in so many labelled documents
#: or more, and with shares that differ by so many standard errors.
VOCABULARY, SEEN, CLEAR = 1500, 4, 4.0
#: Rounds of co-training, the certainty asked for, and pseudo-labels a side passes on in a round.
ROUNDS, SURE, EXCHANGED = 3, 0.97, 300
CHUNK = 1 << 20
TOKEN = re.compile(r"[^\W\d_]+|[^\w\s]+")
SPACE = re.compile(r"\s")
SOURCES, LANGS = 32, 8
TARGETS = ("quality", "toxic")

_SIGNS = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
_PROSE = b".,;:'\"-()?"


def _chunks(text: str):
    at = 0
    while at < len(text):
        m = SPACE.search(text, at + CHUNK)
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end


def content(text: str | None) -> set[str]:
    """Distinct words (letters, lower case) and runs of signs."""
    out: set[str] = set()
    for part in _chunks(text or ""):
        out.update(TOKEN.findall(part.lower()))
    return out


def metadata(text: str | None, source: str | None, lang: str | None) -> list[float]:
    """Lengths, line and character shares, repeated words, hashed source and language."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    left = lambda drop: (len(data) - len(data.translate(None, drop))) / n
    words = same = 0
    for part in _chunks(text or ""):
        w = part.split()
        words += len(w)
        same += sum(map(eq, w, w[1:]))
    lines = data.count(b"\n") + 1
    signs, prose = left(_SIGNS), left(_PROSE)
    upper, digits, pipes = left(bytes(range(65, 91))), left(b"0123456789"), left(b"|")
    row = [np.log1p(len(data)), np.log1p(lines), np.log1p(len(data) / lines), np.log1p(words), len(data) / max(1, words) / 10]
    row += [10 * signs, 10 * (signs - prose), 10 * prose, 3 * upper, 10 * digits, 10 * pipes, 3 * same / max(1, words)]
    row += [float(signs - prose > 0.02), float(upper > 0.3), float(same > 0.2 * words), float(pipes > 0.02), float(words < 5)]
    hot = np.zeros(SOURCES + LANGS)
    if source is not None:
        hot[zlib.crc32(source.encode()) % SOURCES] = 1
    if lang is not None:
        hot[SOURCES + zlib.crc32(lang.encode()) % LANGS] = 1
    return [float(x) for x in (*row, *hot)]


N_META = 17 + SOURCES + LANGS


class Logistic:
    """Logistic regression over rows of (feature, value) lists, by Adam on all rows."""

    def __init__(self, features: int, l2: float):
        self.w, self.b, self.l2 = np.zeros(features), 0.0, l2

    def score(self, rows: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> np.ndarray:
        r, f, v = rows
        return np.bincount(r, self.w[f] * v, n) + self.b

    def fit(self, rows, y: np.ndarray, weight: np.ndarray, steps: int = 250) -> None:
        r, f, v = rows
        m, s = np.zeros(len(self.w) + 1), np.zeros(len(self.w) + 1)
        total = max(weight.sum(), 1e-9)
        for t in range(1, steps + 1):
            d = (_sigmoid(self.score(rows, len(y))) - y) * weight / total
            g = np.append(np.bincount(f, d[r] * v, len(self.w)) + self.l2 * self.w, d.sum())
            m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
            step = 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
            self.w, self.b = self.w - step[:-1], self.b - step[-1]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _rows(lists: list[np.ndarray], values: list[np.ndarray] | None = None):
    r = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    f = np.concatenate(lists).astype(np.int64) if len(lists) else np.empty(0, np.int64)
    return r, f, np.ones(len(f)) if values is None else np.concatenate(values)


def _scale(x: np.ndarray, scores: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(scores)), *([scores] if scores.ndim == 1 else scores.T)], axis=1) @ x


def _calibrate(scores: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights (offset, one for each score) of a logistic map to probabilities, by Newton steps."""
    a = np.column_stack([np.ones(len(y)), scores])
    x = np.zeros(a.shape[1])
    for _ in range(25):
        p = _sigmoid(a @ x)
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(x))
        x = x - np.clip(np.linalg.solve(h, a.T @ (weight * (p - y)) + 1e-2 * x), -3, 3)
    return x


def cotrain(words: list[np.ndarray], meta: np.ndarray, y: np.ndarray, known: np.ndarray, n_words: int, stands_for: np.ndarray | None = None) -> dict:
    """Both classifiers and their calibration for one target.  ``known``: 1 for
    learning, 2 kept apart for calibration, 0 unlabelled; ``stands_for`` weighs
    a labelled document by the rows it stands for."""
    learn, apart = known == 1, known == 2
    stands_for = np.ones(len(y)) if stands_for is None else stands_for
    centre, spread = meta.mean(axis=0), meta.std(axis=0) + 1e-6
    m = np.clip((meta - centre) / spread, -8, 8)
    sides = [
        (Logistic(n_words, 3e-4), _rows(words)),
        (Logistic(m.shape[1], 1e-3), _rows([np.arange(m.shape[1])] * len(m), list(m))),
    ]
    label = [np.where(learn, y, 0.0).astype(float) for _ in sides]
    weight = [learn * stands_for for _ in sides]
    share = np.average(y[learn], weights=stands_for[learn]) if learn.any() else 0.5
    for step in range(ROUNDS + 1):
        for side, (clf, rows) in enumerate(sides):
            clf.fit(rows, label[side], weight[side])
        if step == ROUNDS:
            break
        for side, (clf, rows) in enumerate(sides):  # teach the other side
            p = _sigmoid(clf.score(rows, len(y)))
            other = 1 - side
            for value, sure, most in ((1, p, EXCHANGED * share), (0, 1 - p, EXCHANGED * (1 - share))):
                free = np.flatnonzero((known == 0) & (weight[other] == 0) & (sure >= SURE))
                pick = free[np.argsort(-sure[free], kind="stable")][: int(np.ceil(most))]
                label[other][pick], weight[other][pick] = value, 0.5
    scores = np.column_stack([clf.score(rows, len(y)) for clf, rows in sides])
    on = apart if apart.any() else learn
    own = [_calibrate(scores[on, k], y[on], stands_for[on]) for k in range(2)]
    both = _calibrate(np.column_stack([_scale(own[k], scores[on, k]) for k in range(2)]), y[on], stands_for[on])
    return {"w": sides[0][0].w, "wb": sides[0][0].b, "m": sides[1][0].w, "mb": sides[1][0].b, "centre": centre, "spread": spread, "own": own, "both": both}


def apply(model: dict, words: np.ndarray, meta: np.ndarray) -> tuple[float, float, float]:
    """Calibrated probabilities of one document: content, metadata, combined."""
    a = model["w"][words].sum() + model["wb"]
    b = np.clip((meta - model["centre"]) / model["spread"], -8, 8) @ model["m"] + model["mb"]
    logits = [model["own"][0] @ [1, a], model["own"][1] @ [1, b]]
    return float(_sigmoid(logits[0])), float(_sigmoid(logits[1])), float(_sigmoid(model["both"] @ [1, *logits]))


def _views(docs: DataFrame, extra: list[str]) -> DataFrame:
    def make():
        def one(text, source, lang, *more):
            return (*more, sorted(content(text)), metadata(text, source, lang))

        return one

    cols = [col("text"), *_side_columns(docs), *[F.col(c) for c in extra]]
    return map_rows(docs.select(*cols), make, ", ".join(f"{c} int" for c in extra) + ", words array<string>, meta array<double>", weigh=lambda r: 12 * len(r[-2]))


def _side_columns(docs: DataFrame) -> list:
    have = {c.lower() for c in docs.columns}
    return [(col(c).cast("string") if c in have else F.lit(None).cast("string")).alias(f"__{c}") for c in ("source", "lang")]


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """Models by target, and the content features' numbers.

    The sample is bounded (see ``LABELLED``): labels are thinned and chosen
    by hash within each class (quality, toxic), so that a rare class is not
    lost, and weigh as much as the labels they stand for.  A null label does
    not count; an id's labels are their largest.  Of several documents with
    one id a hash chooses one; copies of an unlabelled text count once."""
    rated = labels.select(col("doc_id").alias("l_id"), *[col(t).cast("int").alias(f"l_{t}") for t in TARGETS]).where("l_id is not null")
    rated = rated.groupBy("l_id").agg(*[F.max(f"l_{t}").alias(f"l_{t}") for t in TARGETS]).where("l_quality is not null or l_toxic is not null")
    rated = reliable(rated)
    classes = [f"l_{t}" for t in TARGETS]
    sizes = {(r[0], r[1]): r["n"] for r in rated.groupBy(*classes).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = max(1, sum(sizes.values()))
    take = {c: min(n, max(LABELLED // 12, round(LABELLED * n / total))) for c, n in sizes.items()}
    stands = {c: (n / total) * sum(take.values()) / max(1, take[c]) for c, n in sizes.items()}
    chosen = F.lit(False)
    most = F.lit(0)
    for (q, t), n in sizes.items():
        same = F.col("l_quality").eqNullSafe(F.lit(q)) & F.col("l_toxic").eqNullSafe(F.lit(t))
        chosen = chosen | same & (F.pmod(F.xxhash64("l_id", F.lit(3)), F.lit(max(1, n // (4 * take[q, t])))) == 0)
        most = F.when(same, take[q, t]).otherwise(most)
    in_class = Window.partitionBy(*classes).orderBy(F.xxhash64("l_id"), "l_id")
    some = rated.where(chosen).withColumn("__r", F.row_number().over(in_class)).where(F.col("__r") <= LABELLED)
    some = reliable(some.where(F.col("__r") <= most).drop("__r"))
    n = docs.count()
    narrow = docs.select("doc_id", col("text").cast("string").alias("text"), *[c.alias(n) for c, n in zip(_side_columns(docs), ("source", "lang"))])
    tag = F.xxhash64("text", "source", "lang")
    one = F.min(F.struct(tag.alias("h"), "text", "source", "lang")).alias("d")
    mine = narrow.join(F.broadcast(some), narrow["doc_id"] == some["l_id"]).groupBy("l_id", *classes).agg(one)
    mine = mine.withColumn("known", F.when(F.pmod(F.xxhash64("l_id", F.lit(5)), F.lit(4)) == 0, 2).otherwise(1).cast("int")).select("d.text", "d.source", "d.lang", *classes, "known")
    pool = narrow.where(F.pmod(F.xxhash64("text", F.lit(8)), F.lit(max(1, n // UNLABELLED))) == 0)
    rest = pool.join(F.broadcast(some), pool["doc_id"] == some["l_id"], "left_anti").groupBy(F.xxhash64("text").alias("h")).agg(one).select("d.text", "d.source", "d.lang")
    rest = rest.withColumns({"l_quality": F.lit(None).cast("int"), "l_toxic": F.lit(None).cast("int"), "known": F.lit(0)})
    extra = ["l_quality", "l_toxic", "known"]
    seen = _views(mine, extra).union(_views(rest, extra))
    seen = reliable(seen.withColumns({"k": F.monotonically_increasing_id(), "h": F.xxhash64("words", "meta")}))

    words: set[str] = set()
    for t in TARGETS:
        learn = seen.where((F.col("known") == 1) & F.col(f"l_{t}").isNotNull())
        size = learn.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(f"l_{t}"), F.lit(0)).alias("p")).first()
        per = learn.select(f"l_{t}", F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("d"), F.sum(f"l_{t}").alias("p"))
        gap = F.abs(F.col("p") / max(1, size["p"]) - (F.col("d") - F.col("p")) / max(1, size["n"] - size["p"]))
        # difference of the shares in standard errors
        rate = F.col("d") / max(1, size["n"])
        error = F.sqrt((rate * (1 - rate) + 1e-4) * (1 / max(1, size["p"]) + 1 / max(1, size["n"] - size["p"])))
        best = per.where(F.col("d") >= SEEN).withColumn("s", gap / error).where(F.col("s") >= CLEAR).orderBy(F.col("s").desc(), "word").limit(VOCABULARY)
        words |= {r["word"] for r in best.collect()}
    number = {w: k for k, w in enumerate(sorted(words))}
    vocabulary = docs.sparkSession.createDataFrame([(w,) for w in number], "word string")
    hits = seen.select("k", F.explode("words").alias("word")).join(F.broadcast(vocabulary), "word")
    joined = seen.join(hits.groupBy("k").agg(F.collect_set("word").alias("hits")), "k", "left")
    lists, meta, y, known = [], [], [], []
    for r in joined.select("known", "l_quality", "l_toxic", "meta", "hits").orderBy("h", "known", "l_quality", "l_toxic").collect():
        lists.append(np.array(sorted(number[w] for w in r["hits"] or []), np.int64))
        meta.append(r["meta"])
        y.append((r["l_quality"], r["l_toxic"]))
        known.append(r["known"])
    meta, known = np.array(meta).reshape(-1, N_META), np.array(known, int)
    models = {}
    for t, target in enumerate(TARGETS):
        here = np.array([v[t] is not None for v in y], bool)
        state = np.where(here, known, 0)
        value = np.array([v[t] or 0 for v in y], float)
        if len({*value[state == 1].tolist()}) == 2:
            weight = np.array([stands.get(v, 1.0) for v in y])
            models[target] = cotrain(lists, meta, value, state, len(number), weight)
    return {"number": number, "models": models}


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", cut: float = 0.5, carry: bool = False) -> DataFrame:
    """One row per document: id, ``quality_content``, ``quality_metadata``,
    ``quality`` and ``toxic`` (probabilities: both views of quality, combined,
    and combined toxicity) and ``keep``: quality is at least ``cut`` and
    toxicity below it.  With ``carry`` all columns of ``docs`` come first.

    Null texts count as empty, null sources and languages as no such feature;
    columns other than text, source and lang are no inputs.  With ``carry``,
    columns that bear one of the new names are an error.  A target without
    labels of both kinds is not judged (quality 1, toxicity 0).  Repeated rows
    are all kept; an empty table gives an empty result.
    """
    out = ["quality_content", "quality_metadata", "quality", "toxic", "keep"]
    names = docs.columns if carry else [id_col]
    clash = {c.lower() for c in names} & {*out}
    if clash:
        raise ValueError(f"rename {sorted(clash)} of the documents first")
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs.withColumnRenamed(id_col, "doc_id"), labels))

    def make():
        number, models = shared.value["number"], shared.value["models"]

        def one(text, source, lang, *row):
            words = np.array([number[w] for w in content(text) if w in number], np.int64)
            meta = np.array(metadata(text, source, lang))
            q = apply(models["quality"], words, meta) if "quality" in models else (1.0, 1.0, 1.0)
            t = apply(models["toxic"], words, meta)[2] if "toxic" in models else 0.0
            return (*row, *q, t, q[2] >= cut and t < cut)

        return one

    kept = [f for f in docs.schema.fields if f.name in names]
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept)
    schema += ", quality_content double, quality_metadata double, quality double, toxic double, keep boolean"
    at = 0 if not carry else names.index("text")
    cols = [col("text").alias("__text"), *_side_columns(docs), *[col(f.name) for f in kept]]
    return map_rows(docs.select(*cols), make, schema, weigh=(lambda r: len(r[at] or "")) if carry else None)


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, as they were."""
    plain = docs.select(*[col(c).alias(c if c in ("doc_id", "text", "source", "lang") else f"__{k}") for k, c in enumerate(docs.columns)])
    kept = score_documents(plain, labels, carry=True).where("keep")
    return kept.select(*[F.col(p).alias(c) for p, c in zip(plain.columns, docs.columns)])
