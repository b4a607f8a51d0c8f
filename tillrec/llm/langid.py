"""Language identification by a bidirectional gated recurrent network over bytes.

The network labels every byte position with language scores; a document's
probabilities are the mean over the positions of its letters.  It is trained
in numpy by backpropagation through time on windows of a bounded sample of
labelled documents, and run over every byte of every text in overlapping
windows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillrec.llm import recurrent as R
from tillrec.llm.common import col, reliable

#: Bound of the training sample: documents of a language, and windows of one document.
DOCS_PER_LANG = 400
WINDOWS_PER_DOC = 3
WINDOW_CHARS = 120
#: Most languages whose counts (some 50 bytes each) are broadcast.
MAX_LANGS = 10_000
HIDDEN = 8
EPOCHS = 7
#: Windows of the run, and bytes of context that neighbours share.
SIZE, OVERLAP = 512, 32
FLUSH = 1 << 21
UNKNOWN = "und"
#: Bytes that count in a document's mean: ASCII letters and all bytes of other characters.
LETTER = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(F.encode(id_col.cast("string"), "UTF-8")), F.lit(4)) == 2


def as_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in text or "")


def training_windows(labelled: DataFrame) -> list[tuple[str, str]]:
    """(language, window text) of a bounded, hash-chosen sample of each language's distinct texts."""
    starts = F.transform(
        F.sequence(F.lit(1), F.lit(WINDOWS_PER_DOC)),
        lambda k: F.pmod(F.xxhash64("text", k), F.greatest(F.length("text") - WINDOW_CHARS + 1, F.lit(1))) + 1,
    )
    # copies of a text count once; thin common languages by hash to some four
    # times what is needed, then take the first of each by another hash
    hashed = labelled.withColumn("__h", F.xxhash64("text"))
    counts = hashed.select("lang", "__h").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("__n"))
    counts = reliable(counts.select("lang", F.greatest(F.floor(F.col("__n") / (4 * DOCS_PER_LANG)), F.lit(1)).alias("__step")))
    few = counts.count() <= MAX_LANGS
    hashed = hashed.join(F.broadcast(counts) if few else counts, "lang")
    parts = F.transform(F.array_distinct(starts), lambda a: F.substring(F.col("text"), a.cast("int"), F.lit(WINDOW_CHARS)))
    thin = hashed.where(F.pmod("__h", "__step") == 0).select("lang", "__h", F.xxhash64("text", F.lit(0)).alias("__o"), parts.alias("__parts"))
    once = thin.groupBy("lang", "__h").agg(F.min(F.struct("__o", "__parts")).alias("__first")).select("lang", "__h", "__first.*")
    w = Window.partitionBy("lang").orderBy("__o", "__h")
    sample = once.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= DOCS_PER_LANG)
    rows = sample.select("lang", F.explode("__parts").alias("part"))
    return sorted((r["lang"], r["part"]) for r in rows.collect())


def fit(windows: list[tuple[str, str]], seed: int = 42) -> tuple[list[str], R.Params]:
    """Languages and network weights; every window's bytes are labelled with its language."""
    langs = sorted({lang for lang, _ in windows})
    p = R.fresh("gru", 256, HIDDEN, max(1, len(langs)), seed)
    parts = [(langs.index(lang), as_bytes(t)) for lang, t in windows if t]
    if len(langs) < 2 or not parts:
        return langs, p
    n = np.array([len(b) for _, b in parts])
    x = np.zeros((len(parts), int(n.max())), np.uint8)
    for k, (_, b) in enumerate(parts):
        x[k, : len(b)] = b
    y = np.array([k for k, _ in parts])
    weight = 1.0 / np.bincount(y, minlength=len(langs))[y]
    weight = weight / weight.mean()

    def loss(p, scores, pick):
        prob = np.exp(scores - scores.max(axis=2, keepdims=True))
        prob /= prob.sum(axis=2, keepdims=True)
        live = (np.arange(len(scores))[:, None] < n[pick]) * weight[pick]
        lane = np.arange(len(pick))
        nll = -(np.log(prob[:, lane, y[pick]] + 1e-9) * live).sum() / live.sum()
        prob[:, lane, y[pick]] -= 1
        return nll, prob * (live / live.sum())[:, :, None], {}

    return langs, R.train(p, "gru", x, n, loss, EPOCHS, 128, 0.02, seed)


def probabilities(p: R.Params, seqs: list[np.ndarray]) -> np.ndarray:
    """Mean class probabilities over the letter positions of each byte sequence."""
    total, count = np.zeros((len(seqs), len(p["bias"]))), np.zeros(len(seqs))
    for rows, x, n in R.lanes(seqs, SIZE, OVERLAP):
        s = R.outputs(p, "gru", x, n)
        s -= s.max(axis=1, keepdims=True)
        np.exp(s, out=s)
        at = np.arange(len(x))[:, None] + rows[:, 1]
        own = (at >= rows[:, 3]) & (at < rows[:, 4]) & (np.arange(len(x))[:, None] < n) & LETTER[x]
        s *= (own / s.sum(axis=1))[:, None, :]
        np.add.at(total, rows[:, 0], s.sum(axis=0, dtype=np.float64).T)
        np.add.at(count, rows[:, 0], own.sum(axis=0))
    return total / np.maximum(count, 1)[:, None]


def predict_language(docs: DataFrame, langs: list[str], p: R.Params, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``lang_pred`` and ``score`` of every row; ``und`` with score 0 for
    a text that is null, empty or without letters, or if nothing was learned;
    of equally probable languages the smaller by code point."""
    shared = docs.sparkSession.sparkContext.broadcast((langs, p))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        langs, p = shared.value

        def emit(ids, seqs):
            pred, score = [UNKNOWN] * len(ids), np.zeros(len(ids))
            live = [k for k, s in enumerate(seqs) if s is not None]
            if langs and live:
                prob = probabilities(p, [seqs[k] for k in live])
                for k, row in zip(live, prob):
                    pred[k], score[k] = langs[int(row.argmax())], min(1.0, float(row.max()))
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(pred), pa.array(score)], names=["doc_id", "lang_pred", "score"])

        ids, seqs, held = [], [], 0
        id_type = None
        for b in batches:
            id_type = b.column(0).type
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                text = t.as_py()
                ids.append(i)
                seqs.append(as_bytes(text) if has_letter(text) else None)
                held += len(seqs[-1]) if seqs[-1] is not None else 0
                if held >= FLUSH:
                    yield emit(ids, seqs)
                    ids, seqs, held = [], [], 0
        if ids:
            yield emit(ids, seqs)

    return docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def identify_languages(docs: DataFrame, seed: int = 42) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` of every document.

    Learns from text and non-null lang of documents that are not held out (a
    null id counts as empty text and so is not), at most ``DOCS_PER_LANG`` of
    each language.  Repeated rows are all kept; an empty table, or one
    without labels, gives ``und`` throughout.
    """
    usable = docs.where(col("lang").isNotNull() & col("text").isNotNull() & ~F.coalesce(held_out(col("doc_id")), F.lit(False)))
    langs, p = fit(training_windows(usable.select("lang", "text").where(F.col("text").rlike(r"\p{L}"))), seed)
    found = predict_language(docs, langs, p)
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
