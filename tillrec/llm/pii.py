"""Personal data in texts: exact patterns, and a character-level bidirectional
LSTM with CRF transitions that finds what the patterns cannot.

The network is trained in numpy from labelled spans: windows of a bounded
sample of documents, labelled by the patterns, with spans of other spellings
and look-alikes written into some of them.  It runs over every character of
every text in overlapping windows; each window is decoded by itself, a
position's tag is taken from the window in whose middle part it lies, and
spans are read off the tags of the whole text.  A span that the network adds
must lie clear of the patterns' spans and pass the check of its kind.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillrec.llm import recurrent as R
from tillrec.llm.common import col

KINDS = ["email", "ip", "card", "phone"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The patterns, so written that long runs take linear time: a local part is read
# back from its @, and a run of digits is tried only from its start.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Bound of the training sample: distinct texts looked at (some two times as many at
#: most, by hash), windows at a digit or @ sign, and windows anywhere.
SAMPLE_DOCS = 300_000
SIGN_WINDOWS = 2500
PLAIN_WINDOWS = 800
WINDOW_CHARS = 112
SYMBOLS = 129
#: Copies with something written in that a fit has at least.
WRITTEN = 3000
HIDDEN = 8
EPOCHS = 8
SIZE, OVERLAP = 512, 64
FLUSH = 1 << 21

Span = tuple[int, int, int]  # kind, start, end


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str):
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def ip_parts(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in s.split("."))


def base_spans(text: str) -> list[Span]:
    """Matches of the patterns that pass their checks, by kind and start."""
    out = [(0, a, b) for a, b in emails(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if ip_parts(m[0])]
    out += [(2, m.start(), m.end()) for m in CARD.finditer(text) if 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return out


FORMS = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]{1,3}(\.[0-9]{1,3}){3}"),
    re.compile(r"[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4,7}"),
    re.compile(r"(\+[0-9]{1,3}[\x20.-]?)?(\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-][0-9]{2,4}([\x20.-][0-9]{2,4}){1,3}"),
]


def plausible(kind: int, text: str, start: int, end: int) -> bool:
    """The check that a span added by the network must pass: the written form
    of its kind, complete (no letter or digit on either side), numbers in range."""
    s = text[start:end]
    if not FORMS[kind].fullmatch(s):
        return False
    around = text[max(0, start - 1) : start] + text[end : end + 1]
    if any(c.isalnum() or c in "@_" for c in around):
        return False
    d = digits_of(s)
    if kind == 1:
        return ip_parts(s)
    if kind == 2:
        return luhn(d)
    return kind != 3 or 8 <= len(d) <= 15


def symbols(text: str) -> np.ndarray:
    """One symbol per code point: ASCII by itself, all else as one."""
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 128).astype(np.uint8)


def training_windows(docs: DataFrame) -> list[str]:
    """A bounded sample of windows of distinct texts, chosen by hash: one at a
    digit or @ of a text that has one (the first behind a place given by the
    hash, or else the first), and one anywhere of any text."""
    text = docs.where(F.length("text") > 0).select("text", F.xxhash64("text").alias("h"))
    step = max(1, text.select("h").distinct().count() // SAMPLE_DOCS)  # so no task or driver sees more than a bounded share
    text = text.where(F.pmod("h", F.lit(step)) == 0)
    sign = text.withColumn("at", F.regexp_instr(F.col("text"), F.lit("[0-9@]"))).where("at > 0")
    place = F.pmod(F.col("h"), F.length("text")).cast("int") + 1
    behind = F.regexp_instr(F.substring(F.col("text"), place, F.length("text")), F.lit("[0-9@]"))
    sign = sign.withColumn("at", F.when(behind > 0, behind + place - 1).otherwise(F.col("at")))
    near = sign.select("h", F.substring("text", F.greatest(F.col("at") - 48, F.lit(1)), F.lit(WINDOW_CHARS)).alias("w"))
    start = F.pmod(F.col("h"), F.greatest(F.length("text") - WINDOW_CHARS + 1, F.lit(1))).cast("int") + 1
    any_ = text.select("h", F.substring("text", start, F.lit(WINDOW_CHARS)).alias("w"))

    def some(windows: DataFrame, seed: int, n: int) -> list:
        once = windows.groupBy("h").agg(F.min("w").alias("w"))  # copies of a text count once
        return once.orderBy(F.xxhash64("h", F.lit(seed)), "h").limit(n).collect()

    rows = [*some(near, 1, SIGN_WINDOWS), *some(any_, 2, PLAIN_WINDOWS)]
    return [r["w"] for r in rows]


def _number(rng, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _card(rng) -> str:
    body = str(rng.integers(3, 7)) + _number(rng, 14)
    last = next(c for c in "0123456789" if luhn(body + c))
    return body + last


#: Spellings of a number to call that the patterns do not take: each third of them is written equally often.
SPELLINGS = ["({}) {}-{}", "{}-{}-{}", "{}.{}.{}"]


def written(rng) -> tuple[int, str]:
    """A span to write into a window: (kind + 1, text), or a look-alike (0,
    text).  Half are the spellings that only the network can find, a third are
    look-alikes, the rest are spans that the patterns find as well."""
    n = lambda k: _number(rng, k)
    turn = int(rng.integers(0, 12))
    if turn < 6:
        return 4, SPELLINGS[turn % 3].format(n(3), n(3), n(4))
    if turn < 10:
        return 0, [
            n(4), n(int(rng.integers(5, 13))), f"{n(1)}.{n(2)}", f"{n(1)}.{n(1)}.{n(2)}", f"20{n(2)}-0{n(1)}-1{n(1)}",
            f"{n(2)}:{n(2)}", "".join("0123456789abcdef"[k] for k in rng.integers(0, 16, 32)), f"@user{n(2)}", f"{n(1)}-{n(2)}",
            f"{n(3)}.{n(3)}", f"{n(3)}-{n(3)}", f"{n(2)}.{n(2)}.{n(4)}",
        ][rng.integers(0, 12)]
    kind = int(rng.integers(0, 4))
    if kind == 0:
        return 1, f"{'abcdefgh'[rng.integers(0, 8)]}{n(2)}.mail+{n(1)}@host-{n(1)}.example.org"
    if kind == 1:
        return 2, ".".join(str(rng.integers(0, 256)) for _ in range(4))
    if kind == 2:
        c = _card(rng)
        return 3, "".join([c, " ".join(re.findall("....", c)), "-".join(re.findall("....", c))][rng.integers(0, 3)])
    return 4, [f"+{n(2)} {n(3)} {n(3)} {n(3)}", f"+1 ({n(3)}) 555-{n(4)}"][rng.integers(0, 2)]


def labelled(windows: list[str], seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(symbols, tags) of the windows as they are, and of copies with a span or
    look-alike written in at a blank: one of each window, and as many more as
    make ``WRITTEN`` copies where windows are few."""
    rng, out = np.random.default_rng(seed), []

    def add(text: str, more: Span | None = None) -> None:
        tags = np.zeros(len(text), np.int64)
        for kind, a, b in base_spans(text):
            tags[a:b] = kind + 1
        if more:
            tags[more[1] : more[2]] = more[0]
        out.append((symbols(text), tags))

    for w in windows:
        add(w)
    for w in windows * max(1, -(-WRITTEN // max(1, len(windows)))):
        kind, s = written(rng)
        at = w.find(" ", int(rng.integers(0, max(1, len(w) - 40))))
        at = len(w) if at < 0 else at
        before = w[:at] + " " + (_number(rng, 2) + " " if rng.random() < 0.1 else "")
        after = str(rng.choice([" ", ", ", ". ", ""])) + w[at + 1 :] if rng.random() < 0.3 else w[at:]
        add((before + s + after)[: WINDOW_CHARS + 48], (kind, len(before), len(before) + len(s)))
    return [(x, y) for x, y in out if len(x)]


def crf_loss(trans: np.ndarray, scores: np.ndarray, tags: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of the tags (time, lane) under scores
    (time, lane, classes) and transitions, and both gradients."""
    steps, width, classes = scores.shape
    lane = np.arange(width)
    live = np.arange(steps)[:, None] < n
    top = scores.max(axis=2, keepdims=True)
    e, m = np.exp(scores - top), np.exp(trans)
    alpha, norm = np.empty_like(e), np.ones((steps, width), e.dtype)
    a = e[0]
    for t in range(steps):
        if t:
            a = np.where(live[t][:, None], (alpha[t - 1] @ m) * e[t], alpha[t - 1])
        norm[t] = a.sum(axis=1)
        alpha[t] = a / norm[t][:, None]
    log_z = (np.log(norm) * live + top[:, :, 0] * live).sum()
    beta, expect, grad = np.ones((width, classes), e.dtype), np.zeros_like(m), np.empty_like(e)
    for t in range(steps - 1, -1, -1):
        both = alpha[t] * beta
        grad[t] = both / both.sum(axis=1, keepdims=True)
        if t:
            right = e[t] * beta
            pair = alpha[t - 1][:, :, None] * m * right[:, None, :]
            pair *= (live[t] / pair.sum(axis=(1, 2)))[:, None, None]
            expect += pair.sum(axis=0)
            back = right @ m.T
            beta = np.where(live[t][:, None], back / back.max(axis=1, keepdims=True), beta)
    gold = (np.take_along_axis(scores, tags[:, :, None], 2)[:, :, 0] * live).sum()
    moves = live[1:]
    gold += (trans[tags[:-1], tags[1:]] * moves).sum()
    np.subtract.at(expect, (tags[:-1][moves], tags[1:][moves]), 1)
    grad[np.arange(steps)[:, None], lane, tags] -= 1
    grad *= live[:, :, None]
    total = live.sum()
    return float((log_z - gold) / total), grad / total * 20, expect / total * 20


def fit(samples: list[tuple[np.ndarray, np.ndarray]], seed: int = 42) -> R.Params:
    classes = len(KINDS) + 1
    p = R.fresh("lstm", SYMBOLS, HIDDEN, classes, seed)
    p["trans"] = np.zeros((classes, classes), np.float32)
    if not samples:
        p["bias"][0] = 100.0  # nothing learned: tags nothing
        return p
    n = np.array([len(x) for x, _ in samples])
    x, y = np.zeros((len(samples), n.max()), np.uint8), np.zeros((len(samples), n.max()), np.int64)
    for k, (a, b) in enumerate(samples):
        x[k, : len(a)], y[k, : len(b)] = a, b

    def loss(p, scores, pick):
        value, grad, moves = crf_loss(p["trans"], scores, y[pick].T[: len(scores)], n[pick])
        return value, grad, {"trans": moves.astype(np.float32)}

    return R.train(p, "lstm", x, n, loss, EPOCHS, 256, 0.05, seed)


def viterbi(trans: np.ndarray, s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Best tags (time, lane) for scores (time, classes, lane) of lengths n."""
    steps, _, width = s.shape
    back = np.empty(s.shape, np.int8)
    best = s[0].copy()
    for t in range(1, steps):
        moved = best[:, None, :] + trans[:, :, None]
        back[t] = moved.argmax(axis=0)
        best = np.where(t < n, moved.max(axis=0) + s[t], best)
    lane, tags = np.arange(width), np.zeros((steps, width), np.int64)
    tag = best.argmax(axis=0)
    for t in range(steps - 1, -1, -1):
        tags[t] = np.where(t < n, tag, 0)
        if t:
            tag = np.where(t < n, back[t][tag, lane], tag)
    return tags


def may_leave(trans: np.ndarray, s: np.ndarray, n: np.ndarray, margin: float = 0.01) -> np.ndarray:
    """Lanes whose best path may have a tag other than 0.

    A path is a row of excursions from tag 0, and the best one stays at 0 if
    no excursion gains.  Over staying, an excursion gains at most ``enter`` for
    its first transition, ``stay`` for each further one, ``leave`` for the way
    back, and at each position what the best other tag scores above tag 0.
    The best gain of an excursion that is still out at a position is a running
    maximum, so one pass over time bounds them all; ``margin`` covers rounding."""
    gap = s[:, 1:].max(axis=1) - s[:, 0]
    base = trans[0, 0]
    enter, stay, leave = (float(t.max() - base) for t in (trans[0, 1:], trans[1:, 1:], trans[1:, 0]))
    out = gap[0].copy()  # nothing to enter from at the first position
    most = np.where(n == 1, out, out + leave)
    for t in range(1, len(s)):
        out += stay
        np.maximum(out, enter, out=out)
        out += gap[t]
        live = np.where(t == n - 1, out, out + leave)
        np.maximum(most, live, out=most, where=t < n)
    return most > -margin


def tagged(p: R.Params, seqs: list[np.ndarray]) -> dict[int, np.ndarray]:
    """Tags of those sequences that have any tag but 0; only the windows that
    ``may_leave`` tag 0 need the decoding."""
    out: dict[int, np.ndarray] = {}
    trans = p["trans"]
    for rows, x, n in R.lanes(seqs, SIZE, OVERLAP):
        s = R.outputs(p, "lstm", x, n)
        pick = np.flatnonzero(may_leave(trans, s, n))
        if not len(pick):
            continue
        tags = viterbi(trans, s[:, :, pick], n[pick])
        for lane, (k, start, _, own, cut) in enumerate(rows[pick].tolist()):
            some = tags[own - start : cut - start, lane]
            if some.any():
                if k not in out:
                    out[k] = np.zeros(len(seqs[k]), np.int64)
                out[k][own:cut] = some
    return out


EDGE = " \t\n\r.,;:!?()[]{}<>\"'|*#$%&"


def added_spans(text: str, tags: np.ndarray, base: list[Span]) -> list[Span]:
    """Spans of equal tags, without punctuation at their ends, that are
    plausible and clear of the base spans."""
    edge = np.flatnonzero(np.diff(tags)) + 1
    taken = sorted((a, b) for _, a, b in base)
    out = []
    for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(tags)]):
        kind = int(tags[a]) - 1
        if kind < 0:
            continue
        while a < b and text[a] in EDGE and not (kind == 3 and text[a] == "("):
            a += 1
        while a < b and text[b - 1] in EDGE:
            b -= 1
        if a < b and plausible(kind, text, a, b) and not any(x < b and a < y for x, y in taken):
            out.append((kind, a, b))
    return out


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """One row per document: ``doc_id`` and ``spans``, an array of (kind,
    start, end, base) by kind as listed in ``KINDS``, then start; code points,
    end exclusive; ``base`` tells the patterns' spans from the network's.

    Null and empty texts have none; repeated rows are all kept; an empty table
    gives an empty result.
    """
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    p = fit(labelled(training_windows(rows), seed), seed)
    shared = docs.sparkSession.sparkContext.broadcast(p)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        p = shared.value
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

        def emit(ids, texts):
            found = tagged(p, [symbols(t) for t in texts])
            spans = []
            for k, t in enumerate(texts):
                base = base_spans(t)
                more = added_spans(t, found[k], base) if k in found else []
                every = sorted([(*s, True) for s in base] + [(*s, False) for s in more])
                spans.append([{"kind": KINDS[a], "start": b, "end": c, "base": d} for a, b, c, d in every])
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(spans, pa.list_(span))], names=["doc_id", "spans"])

        ids, texts, held, id_type = [], [], 0, None
        for b in batches:
            id_type = b.column(0).type
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids.append(i)
                texts.append(t.as_py() or "")
                held += len(texts[-1])
                if held >= FLUSH:
                    yield emit(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield emit(ids, texts)

    return rows.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")


def pii_digest(docs: DataFrame) -> DataFrame:
    """Counts of the patterns' spans by kind, their digest, and all spans as text."""
    found = find_pii(docs)
    base = F.filter("spans", lambda s: s.base)
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s.base & (s.kind == k))).cast("bigint")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s.base)).cast("bigint").alias("n_added"),
    )
