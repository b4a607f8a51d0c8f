"""Removal of repeated byte strings by prefix-free parsing.

A byte is removed if some ``span``-byte string over it also starts in a
document with a smaller id.  The text is parsed by rolling hashes: the
trigger of a window (a ``span``-byte string) is its smallest hash over
``gram`` bytes, and a phrase is a run of windows with one trigger.  Equal
windows have equal triggers wherever they stand, so phrases that can share a
window meet under their trigger:

1. The parse.  Phrases are dealt out by trigger as (phrase hash, document,
   place).  One that also occurs in a smaller document is repeated as a
   whole; of the others only the first occurrences under a trigger with
   several different phrases are open.  That is the dictionary's part in
   which suffixes may agree.
2. The dictionary.  The bytes of open phrases are dealt out by trigger and
   the suffixes at their windows are sorted by their first ``span`` bytes (a
   suffix array cut at that length); each run of equal ones knows its smallest
   document.  The phrases' places turn this into places in the corpus.
3. Both kinds of places meet the texts again, and the covered bytes go.

Repetitive text costs little: phrases seen before are settled by hash alone.
Records travel as packed columns, one block for each bucket and flush, with
phrases that a flush has itself seen in a smaller document settled there.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillrec.llm.common import col, reliable

SPAN, GRAM = 50, 20
#: Longest run of windows in a phrase; a cut leaves the trigger as it is.
MAX_WINDOWS = 64
#: Text parsed at a time, text for each bucket, and windows sorted at a time.
FLUSH_TEXT = 4 << 20
BUCKET_TEXT = 8 << 20
SORT_WINDOWS = 1 << 20
#: Phrases under one trigger from which its windows are dealt out one by one.
CROWD = 4096
#: Documents looked at for triggers so common that their phrases are dealt out by themselves.
SAMPLE_DOCS = 2000
COMMON_SHARE = 0.02
WHOLE, OPEN, CROWDED = 1, 2, 3

_rng = np.random.default_rng(20)
BYTE_VALUE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x2545F4914F6CDD1D)
MIX = np.uint64(0xD6E8FEB86659FD93)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= MIX
    h ^= h >> np.uint64(32)
    h *= MIX
    h ^= h >> np.uint64(32)
    return h


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """Mixed polynomial hash of every run of ``width`` bytes, by doubling."""
    n = len(data) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    part, part_len, power = BYTE_VALUE[data], 1, STEP
    out, out_len, bits = None, 0, width
    with np.errstate(over="ignore"):
        while True:
            if bits & 1:
                if out is None:
                    out = part
                else:
                    m = len(data) - out_len - part_len + 1
                    out = out[:m] * power + part[out_len : out_len + m]
                out_len += part_len
            bits >>= 1
            if not bits:
                return mixed(out[:n])
            m = len(part) - part_len
            part = part[:m] * power + part[part_len : part_len + m]
            power = power * power
            part_len *= 2


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    n, reach, cur = len(a) - width + 1, 1, a
    if n <= 0:
        return a[:0]
    while reach * 2 <= width:
        cur = np.minimum(cur[: len(cur) - reach], cur[reach:])
        reach *= 2
    return np.minimum(cur[:n], cur[width - reach :][:n])


def parse(data: np.ndarray, lengths: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, ...]:
    """Phrases of texts laid end to end: segment, start in it, windows, trigger, phrase hash."""
    trigger = sliding_min(rolling(data, gram), span - gram + 1)
    first = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    n = len(trigger)
    valid = np.zeros(n + 1, np.int32)
    has = lengths >= span
    np.add.at(valid, first[has], 1)
    np.add.at(valid, first[has] + lengths[has] - span + 1, -1)
    valid = np.cumsum(valid[:n]).astype(bool)
    if not valid.any():
        z = np.empty(0, np.int64)
        return z, z, z, np.empty(0, np.uint64), np.empty(0, np.uint64)
    new = valid.copy()
    new[1:] &= (trigger[1:] != trigger[:-1]) | ~valid[:-1]
    new[first[has]] = True
    # a run ends where the next begins or where windows end
    edges = np.flatnonzero(new | ~valid)
    starts = edges[valid[edges]]
    ends = np.append(edges, n)[np.searchsorted(edges, starts, side="right")]
    size = ends - starts
    pieces = -(-size // MAX_WINDOWS)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(starts, pieces) + nth * MAX_WINDOWS
    size = np.minimum(np.repeat(ends, pieces) - starts, MAX_WINDOWS)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(rolling(data, span), dtype=np.uint64)])
        phrase = total[starts + size] - total[starts]
    seg = np.searchsorted(first, starts, side="right") - 1
    # empty segments share their start with the next one
    return seg, starts - first[seg], size, trigger[starts], phrase


def pack(*columns: np.ndarray) -> bytes:
    """Columns as one compressed block, integer bytes of like weight together."""
    import zstandard

    parts, head = [], []
    for c in columns:
        head += [len(c), c.dtype.itemsize]
        c = np.ascontiguousarray(c)
        parts.append(c.view(np.uint8).reshape(len(c), -1).T.tobytes() if len(c) else b"")
    return zstandard.compress(np.array([len(columns), *head], "<i8").tobytes() + b"".join(parts), 1)


def unpack(block: bytes, *types: str) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.decompress(block)
    k = int(np.frombuffer(raw, "<i8", 1)[0])
    head = np.frombuffer(raw, "<i8", 2 * k, 8).reshape(k, 2)
    at, out = 8 + 16 * k, []
    for (n, width), t in zip(head.tolist(), types):
        c = np.frombuffer(raw, np.uint8, n * width, at)
        out.append(np.ascontiguousarray(c.reshape(width, n).T).view(t).reshape(-1) if n else np.empty(0, t))
        at += n * width
    return out


BLOCK = "bucket bigint, kind int, block binary"


def _blocks(rows):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())],
        names=["bucket", "kind", "block"],
    )


def _deal(bucket: np.ndarray, kind: int, *columns: np.ndarray):
    """One packed block for each bucket that has records, in their order."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cut = np.flatnonzero(np.diff(b)) + 1
    for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(b)]):
        if hi > lo:
            yield int(b[lo]), kind, pack(*[c[order[lo:hi]] for c in columns])


def _home(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _texts(batches, several: bool):
    """Lists of (id, text hash or 0, bytes) of some FLUSH_TEXT bytes."""
    import xxhash

    out, held = [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1)):
            data = (t.as_py() or "").encode("utf-8", "surrogatepass")
            out.append((i, xxhash.xxh64_intdigest(data) >> 1 if several else 0, data))
            held += len(data) + 64
            if held >= FLUSH_TEXT:
                yield out
                out, held = [], 0
    if out:
        yield out


def _segments(texts, span: int):
    """Texts cut into segments that share span - 1 bytes: (text number, offset, bytes)."""
    for k, (_, _, data) in enumerate(texts):
        for at in range(0, max(1, len(data) - span + 1), FLUSH_TEXT):
            yield k, at, data[at : at + FLUSH_TEXT + span - 1]


def _parsed(texts, span: int, gram: int):
    """Phrases of texts with ids, a flush at a time: id, hash, start, windows, trigger, phrase."""
    ids = np.array([i for i, _, _ in texts], np.int64)
    hashes = np.array([h for _, h, _ in texts], np.int64)

    def of(group):
        data = np.frombuffer(b"".join(d for _, _, d in group), np.uint8)
        lengths = np.array([len(d) for _, _, d in group])
        owner, offset = np.array([k for k, _, _ in group]), np.array([a for _, a, _ in group])
        seg, start, size, trigger, phrase = parse(data, lengths, span, gram)
        return ids[owner[seg]], hashes[owner[seg]], (start + offset[seg]).astype(np.uint32), size.astype(np.uint8), trigger, phrase

    group, held = [], 0
    for s in _segments(texts, span):
        if len(s[2]) < span:
            continue
        group.append(s)
        held += len(s[2])
        if held >= FLUSH_TEXT:
            yield of(group)
            group, held = [], 0
    if group:
        yield of(group)


def _smallest(keys: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
    """The smallest id among records of equal keys, for each record."""
    order = np.lexsort(keys)
    new = np.zeros(len(ids), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    heads = np.flatnonzero(new)
    low = np.minimum.reduceat(ids[order], heads) if len(heads) else ids
    out = np.empty_like(ids)
    out[order] = np.repeat(low, np.diff(np.append(heads, len(ids))))
    return out


def common_triggers(docs: DataFrame, n: int, span: int, gram: int) -> np.ndarray:
    """Triggers under which a sample of documents has many different phrases.
    A list only steers how phrases are dealt out; any list gives the same result."""
    share = max(1, n // SAMPLE_DOCS)

    def count(batches):
        import pyarrow as pa

        for texts in _texts(batches, False):
            for _, _, _, _, trigger, phrase in _parsed(texts, span, gram):
                pair = np.unique(np.stack([trigger, phrase], axis=1), axis=0)
                t, c = np.unique(pair[:, 0], return_counts=True)
                yield pa.RecordBatch.from_pydict({"t": t[c > 1].view(np.int64), "c": c[c > 1]})

    some = docs.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0)
    rows = some.mapInArrow(count, "t bigint, c bigint").groupBy("t").agg(F.sum("c").alias("c")).where(F.col("c") > COMMON_SHARE * SAMPLE_DOCS)
    return np.sort(np.array([r["t"] for r in rows.orderBy(F.col("c").desc(), "t").limit(10_000).collect()], np.int64).view(np.uint64))


def remove_repeats(
    docs: DataFrame, span: int = SPAN, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_bytes``, ``n_removed``,
    ``n_spans`` (maximal removed runs), ``kept_sha256`` of the remaining bytes
    and, with ``keep_text``, those bytes as ``kept``.

    Null text counts as empty; a row without id neither removes nor loses
    anything; rows with one id do not remove each other's bytes; texts
    shorter than ``span`` stay; very long texts are parsed in overlapping
    pieces; an empty table gives an empty result.  Ids are integers.
    """
    spark = docs.sparkSession
    rows = docs.select(col(id_col).cast("bigint").alias("id"), col(text_col).alias("text"))
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_TEXT), 1)
    known = rows.where("id is not null")
    # only where one id has several texts do text hashes have to tell its rows apart
    hashed = known.groupBy("id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b"))
    several = bool(hashed.where("a <> b").limit(1).count())
    common = common_triggers(known, n, span, gram)
    table = "<i8"

    def ask(batches):
        for texts in _texts(batches, several):
            for ids, hashes, start, windows, trigger, phrase in _parsed(texts, span, gram):
                seen = ids > _smallest([phrase, trigger], ids)
                own = np.isin(trigger, common)
                yield _blocks([
                    *_deal(_home(ids[seen], buckets), 0, ids[seen], hashes[seen], start[seen], windows[seen]),
                    *_deal((np.where(own, mixed(phrase), trigger)[~seen] % np.uint64(buckets)).astype(np.int64), 1, ids[~seen], hashes[~seen], start[~seen], (windows | (own.astype(np.uint8) << 7))[~seen], (trigger[~seen] >> np.uint64(32)).astype(np.uint32), phrase[~seen]),
                ])

    def by_bucket(batches):
        """(bucket, kind -> blocks) of sorted rows."""
        bucket, held = None, {}
        for b in batches:
            for k, kind, block in zip(*[c.to_pylist() for c in b.columns]):
                if bucket is not None and k != bucket:
                    yield bucket, held
                    held = {}
                bucket = k
                held.setdefault(kind, []).append(block)
        if bucket is not None:
            yield bucket, held

    def joined(blocks, *types):
        parts = [unpack(b, *types) for b in blocks]
        return [np.concatenate([p[k] for p in parts]) if parts else np.empty(0, t) for k, t in enumerate(types)]

    def settle(batches):
        for _, held in by_bucket(batches):
            out = []
            if 0 in held:
                ids, hashes, start, windows = joined(held[0], table, table, "<u4", "u1")
                out += _deal(_home(ids, buckets), 0, ids, hashes, start, windows, np.full(len(ids), WHOLE, np.uint8))
            if 1 in held:
                ids, hashes, start, windows, trigger, phrase = joined(held[1], table, table, "<u4", "u1", "<u4", "<u8")
                own = windows >> 7
                first = _smallest([phrase, trigger, own], ids)
                code = np.where(ids > first, WHOLE, np.where(own == 1, CROWDED, 0)).astype(np.uint8)
                # different phrases under each trigger
                order = np.lexsort([phrase, trigger])
                t, p = trigger[order], phrase[order]
                other = own[order] == 0
                new_t = np.ones(len(t), bool)
                new_t[1:] = t[1:] != t[:-1]
                new_p = new_t.copy()
                new_p[1:] |= p[1:] != p[:-1]
                group = np.cumsum(new_t) - 1
                several = np.bincount(group[new_p & other], minlength=group[-1] + 1 if len(group) else 0)[group]
                count = np.empty_like(several)
                count[order] = several
                code = np.where((code == 0) & (count > 1), np.where(count > CROWD, CROWDED, OPEN), code).astype(np.uint8)
                told = code > 0
                windows = windows & 127
                out += _deal(_home(ids[told], buckets), 0, ids[told], hashes[told], start[told], windows[told], code[told])
            yield _blocks(out)

    def text_blocks(batches):
        for texts in _texts(batches, several):
            ids, hashes = np.array([t[0] for t in texts], np.int64), np.array([t[1] for t in texts], np.int64)
            home = _home(ids, buckets)
            out = []
            for k in np.unique(home).tolist():
                some = np.flatnonzero(home == k)
                data = [texts[i][2] for i in some]
                out.append((k, 9, pack(ids[some], hashes[some], np.array(list(map(len, data)), "<i8"), np.frombuffer(b"".join(data), np.uint8))))
            yield _blocks(out)

    def ordered(df: DataFrame) -> DataFrame:
        return df.repartitionById(buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "kind")

    def places(held, kinds: dict[int, tuple]):
        """Records of verdict blocks sorted by (id, hash), and their heads."""
        ids, hashes, start, windows, code = joined(held.get(0, []), table, table, "<u4", "u1", "u1")
        if 1 in kinds and 1 in held:
            i, h, a, c = joined(held[1], table, table, "<u4", "<u4")
            ids, hashes = np.concatenate([ids, i]), np.concatenate([hashes, h])
            start, windows = np.concatenate([start, a]), np.concatenate([windows.astype(np.uint32), c])
            code = np.concatenate([code, np.full(len(i), WHOLE, np.uint8)])
        order = np.lexsort([start, hashes, ids])
        ids, hashes, start, windows, code = (x[order] for x in (ids, hashes, start, windows, code))
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1])
        heads = np.flatnonzero(new)
        at = {(int(ids[a]), int(hashes[a])): (a, b) for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(ids)])}
        return start, windows, code, at

    def gathered(blocks):
        """Text blocks joined to some FLUSH_TEXT bytes."""
        group, size = [], 0
        for block in blocks:
            group.append(unpack(block, table, table, "<i8", "u1"))
            size += len(group[-1][3])
            if size >= FLUSH_TEXT:
                yield [np.concatenate(c) for c in zip(*group)]
                group, size = [], 0
        if group:
            yield [np.concatenate(c) for c in zip(*group)]

    def spread(starts, lengths):
        """start, start + 1, ... of each of many ranges, end to end."""
        total = np.cumsum(lengths)
        return np.repeat(starts - (total - lengths), lengths) + np.arange(total[-1] if len(total) else 0)

    def open_phrases(batches):
        for _, held in by_bucket(batches):
            start, windows, code, at = places(held, {0: ()})
            for ids, hashes, sizes, data in gathered(held.get(9, [])):
                base = np.cumsum(sizes) - sizes
                own, pick = [], []
                for k, key in enumerate(zip(ids.tolist(), hashes.tolist())):
                    a, b = at.get(key, (0, 0))
                    r = np.arange(a, b)[code[a:b] > WHOLE]
                    pick.append(r)
                    own.append(np.full(len(r), k))
                own, pick = np.concatenate(own), np.concatenate(pick)
                for lo in range(0, len(pick), 100_000):
                    o, r = own[lo : lo + 100_000], pick[lo : lo + 100_000]
                    if not len(r):
                        continue
                    first, many, crowd = base[o] + start[r], windows[r].astype(np.int64), code[r] == CROWDED
                    whole = ~crowd
                    grams = data[spread(first, np.full(len(r), span))]
                    trigger = rolling(grams, gram)
                    trigger = np.minimum.reduce([trigger[j :: span][: len(r)] for j in range(span - gram + 1)])
                    out = []
                    if whole.any():
                        bucket = (trigger[whole] % np.uint64(buckets)).astype(np.int64)
                        out += _strings(bucket, ids[o[whole]], hashes[o[whole]], start[r[whole]], windows[r[whole]], first[whole], data)
                    if crowd.any():
                        each = spread(first[crowd], many[crowd])
                        who = np.repeat(np.flatnonzero(crowd), many[crowd])
                        place = (each - base[o[who]]).astype(np.uint32)
                        key = rolling(data, span)[each]
                        i, h = ids[o[who]], hashes[o[who]]
                        seen = i > _smallest([key], i)  # these are settled here
                        if seen.any():
                            out += _deal(_home(i[seen], buckets), 2, i[seen], h[seen], place[seen], np.ones(int(seen.sum()), "<u4"))
                        ask = ~seen
                        out += _strings((key[ask] % np.uint64(buckets)).astype(np.int64), i[ask], h[ask], place[ask], np.ones(int(ask.sum()), np.uint8), each[ask], data)
                    yield _blocks(out)

    def _strings(bucket, ids, hashes, start, windows, first, data):
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        cut = np.flatnonzero(np.diff(b)) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(b)]):
            if hi > lo:
                s = order[lo:hi]
                length = windows[s].astype(np.int64) + span - 1
                yield int(b[lo]), 1, pack(ids[s], hashes[s], start[s], windows[s], data[spread(first[s], length)])

    def suffixes(batches):
        words = -(-span // 8)
        for _, held in by_bucket(batches):
            for block in held.get(2, []):
                ids, hashes, start, count = unpack(block, table, table, "<u4", "<u4")
                yield _blocks(list(_deal(_home(ids, buckets), 1, ids, hashes, start, count)))
            if 1 not in held:
                continue
            ids, hashes, start, windows, data = joined(held[1], table, table, "<u4", "u1", "u1")
            many = windows.astype(np.int64)
            base = np.cumsum(many + span - 1) - (many + span - 1)
            at = spread(base, many)
            who = np.repeat(np.arange(len(ids)), many)
            padded = np.concatenate([data, np.zeros(8 * words, np.uint8)])
            view = np.lib.stride_tricks.sliding_window_view(padded, 8 * words)
            passes = -(-len(at) // SORT_WINDOWS)
            turn = mixed(rolling(padded, 8)[at]) % np.uint64(passes) if passes > 1 else np.zeros(len(at), np.uint64)
            for k in range(passes):
                mine = np.flatnonzero(turn == np.uint64(k))
                text = view[at[mine]].copy()
                text[:, span:] = 0
                keys = text.view(">u8").astype(np.uint64)
                i = ids[who[mine]]
                hit = mine[i > _smallest([keys[:, j] for j in range(words - 1, -1, -1)], i)]
                if not len(hit):
                    continue
                w = who[hit]
                place = start[w].astype(np.int64) + (at[hit] - base[w])
                order = np.lexsort([place, hashes[w], ids[w]])
                w, place = w[order], place[order]
                new = np.ones(len(w), bool)
                new[1:] = (ids[w[1:]] != ids[w[:-1]]) | (hashes[w[1:]] != hashes[w[:-1]]) | (place[1:] != place[:-1] + 1)
                heads = np.flatnonzero(new)
                count = np.diff(np.append(heads, len(w))).astype(np.uint32)
                w = w[heads]
                yield _blocks(list(_deal(_home(ids[w], buckets), 1, ids[w], hashes[w], place[heads].astype(np.uint32), count)))

    def cut_out(batches):
        import pyarrow as pa

        fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), *([("kept", pa.binary())] if keep_text else [])]
        for _, held in by_bucket(batches):
            start, windows, _, at = places(only_whole(held), {0: (), 1: ()})
            for block in held.get(9, []):
                ids, hashes, sizes, data = unpack(block, table, table, "<i8", "u1")
                raw, out, off = data.tobytes(), [], 0
                for i, h, size in zip(ids.tolist(), hashes.tolist(), sizes.tolist()):
                    text = raw[off : off + size]
                    off += size
                    a, b = at.get((i, h), (0, 0))
                    removed, runs, kept = 0, 0, text
                    if b > a:
                        s = start[a:b].astype(np.int64)
                        e = np.maximum.accumulate(s + windows[a:b].astype(np.int64) + span - 1)
                        head = np.ones(len(s), bool)
                        head[1:] = s[1:] > e[:-1]
                        lo, hi = s[head], e[np.append(np.flatnonzero(head)[1:] - 1, len(s) - 1)]
                        removed, runs = int((hi - lo).sum()), len(lo)
                        kept = b"".join(text[x:y] for x, y in zip([0, *hi.tolist()], [*lo.tolist(), size]))
                    out.append((i, size, removed, runs, hashlib.sha256(kept).hexdigest(), *([kept] if keep_text else [])))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, (_, t) in enumerate(fields)], names=[f for f, _ in fields])

    def only_whole(held):
        keep = []
        for block in held.get(0, []):
            c = unpack(block, table, table, "<u4", "u1", "u1")
            whole = c[4] == WHOLE
            keep.append(pack(*[x[whole] for x in c]))
        return {**held, 0: keep}

    verdicts = reliable(ordered(known.mapInArrow(ask, BLOCK)).mapInArrow(settle, BLOCK))
    texts = known.mapInArrow(text_blocks, BLOCK)
    opened = ordered(texts.union(verdicts)).mapInArrow(open_phrases, BLOCK)
    found = ordered(opened).mapInArrow(suffixes, BLOCK)
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if keep_text else "")
    out = ordered(texts.union(verdicts).union(found)).mapInArrow(cut_out, schema)
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    no_id = rows.where("id is null").select(
        F.lit(None).cast("bigint").alias("doc_id"), F.octet_length(text).cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"), *([text.alias("kept")] if keep_text else [])
    )
    return out.union(no_id)
