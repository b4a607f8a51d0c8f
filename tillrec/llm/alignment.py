"""Alignment of two tokenizers over the same bytes, by their token spans.

The first tokenizer (byte-level BPE) gives character offsets, the second
(sentencepiece) the spans of its encoding as a proto.  Token ends from these
spans are coarse cuts: a span says nothing below a character, and of the
byte-fallback tokens of one character only the last has a span at all.  Such
tokens are refined by the bytes they decode to.  Where a token of either side
ends at the same byte, the text is cut into groups.

Neither tokenizer merges across a border between a character that is not
white space and a following space or line feed (the first cuts words there,
and the second's pieces are searched for such a border beforehand).  So texts
are cut into units there.  Units not met before are put together and encoded
in one call a batch; what came out is remembered per unit.  If the pieces do
have such a border, a text is one unit.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillrec.llm.common import col, reliable
from tillrec.llm.tokencount import byte_letters

#: White space with the run behind it, up to a space or line feed that follows something else.
UNIT = re.compile(r"\s*\S+(?:[^\S \n]\s*(?:\S+|\Z))*|\s+")
#: Stands before what the second tokenizer is given, so that the blank it puts in front goes to it.
GUARD = "."
#: Units that a worker remembers (two generations of so many), and the bytes of one call to the libraries.
MEMO_UNITS = 250_000
CALL_BYTES = 1 << 20
#: Pairs of one broadcast (some 13 bytes each).
PAIRS_PER_BLOCK = 2_000_000


def refined(ends: np.ndarray, coarse: np.ndarray, sizes: np.ndarray, ids: list[int]) -> np.ndarray:
    """Byte ends, where those of tokens that share a coarse end with a
    neighbour (parts of one character) come from the decoded bytes."""
    same = coarse[:-1] == coarse[1:]
    if same.any():
        part = np.append(same, False) | np.append(False, same)
        ends = np.where(part, np.cumsum(sizes[ids]), ends)
    return ends


class Aligner:
    """Groups and links of texts under the two vocabularies (the files' bytes)."""

    def __init__(self, first: bytes, second: bytes, memo_units: int = MEMO_UNITS, call_bytes: int = CALL_BYTES):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(first.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=second)
        letters = byte_letters()
        vocab = json.loads(first)["model"]["vocab"]
        self.bytes_a = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.len_a = np.zeros(max(self.bytes_a) + 1, np.int64)
        self.len_a[list(self.bytes_a)] = [len(t) for t in self.bytes_a.values()]
        self.n_b = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.n_b)]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.len_b = np.array([len(t) for t in self.bytes_b], np.int64)
        self.units_hold = not any(re.search(r"[^\s▁][ \n▁]", p) for i, p in enumerate(pieces) if not self.b.is_byte(i))
        self.key = key_type(len(self.len_a), self.n_b)
        self.memo_units, self.call_bytes = memo_units, call_bytes
        self.memo: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}

    # ---- one call
    def ends_first(self, text: str, size: int) -> tuple[list[int], np.ndarray] | None:
        """Ids and byte ends of the first tokenizer, None if it does not give the bytes back."""
        e = self.a.encode(text, add_special_tokens=False)
        ids, data = e.ids, self.bytes_a
        if b"".join([data[i] for i in ids]) != text.encode():
            return None
        chars = np.array([end for _, end in e.offsets], np.int64)
        widths = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum(1 + (widths > 0x7F) + (widths > 0x7FF) + (widths > 0xFFFF))])
        ends = at[chars]
        return ids, refined(ends, chars, self.len_a, ids)

    def ends_second(self, text: str, size: int) -> tuple[list[int], np.ndarray] | None:
        """The same of the second tokenizer, behind the guard."""
        guarded = GUARD + text
        pieces = self.b.encode(guarded, return_type="proto").pieces
        ids = [p.id for p in pieces]
        skip = len(self.b.encode(GUARD))
        data = self.bytes_b
        if b"".join([data[i] for i in ids]) != (" " + guarded).encode():
            return None
        ids = ids[skip:]
        ends = np.array([p.end for p in pieces], np.int64)[skip:] - len(GUARD)  # spans of the proto count bytes
        return ids, refined(ends, ends, self.len_b, ids)

    def align(self, units: list[str]) -> None:
        """Encode ``units``, put together, and remember what came out for each."""
        text = "".join(units)
        try:
            size = len(text.encode())
        except UnicodeEncodeError:
            first = second = None
        else:
            first, second = self.ends_first(text, size), self.ends_second(text, size)
        if first is None or second is None:
            if len(units) == 1:
                self.memo[units[0]] = None
            else:  # the one that is not given back spoils only its half
                half = len(units) // 2
                self.align(units[:half])
                self.align(units[half:])
            return
        (ids_a, ends_a), (ids_b, ends_b) = first, second
        cuts, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        keys = (np.array(ids_a, np.uint64)[at_a] * self.n_b + np.array(ids_b, np.uint64)[at_b]).astype(self.key)
        text_a, text_b = list(map(str, ids_a)), list(map(str, ids_b))
        groups, i, j = [], 0, 0
        for k, m in zip((at_a + 1).tolist(), (at_b + 1).tolist()):
            groups.append(",".join(text_a[i:k]) + "|" + ",".join(text_b[j:m]))
            i, j = k, m
        ends = np.cumsum([len(u.encode()) for u in units])
        last = np.searchsorted(cuts, ends).tolist()  # the group that ends with each unit
        n_a, n_b = (at_a + 1).tolist(), (at_b + 1).tolist()
        g = i = j = 0
        for u, h in zip(units, last):
            h += 1
            k, m = n_a[h - 1], n_b[h - 1]
            self.memo[u] = (k - i, m - j, ";".join(groups[g:h]), keys[g:h].tobytes())
            g, i, j = h, k, m

    def learn(self, texts: list[list[str]]) -> None:
        """See to it that all units of ``texts`` are remembered."""
        if len(self.memo) > self.memo_units:
            self.older, self.memo = self.memo, {}
        memo, older, new = self.memo, self.older, {}
        for units in texts:
            for u in units:
                if u not in memo:
                    if u in older:
                        memo[u] = older[u]
                    else:
                        new[u] = None
        held, size = [], 0
        for u in new:
            if "▁" in u:  # read as a blank, so its bytes cannot come back
                memo[u] = None
            elif u[-1].isspace() or u[0] not in " \n":  # may not stand beside another
                self.align([u])
            else:
                held.append(u)
                size += len(u)
                if size > self.call_bytes:
                    self.align(held)
                    held, size = [], 0
        if held:
            self.align(held)

    def units(self, text: str) -> list[str]:
        return UNIT.findall(" " + text) if self.units_hold else [" " + text]

    def texts(self, texts: list[str | None]) -> list[tuple[int, int, int, str, bytes]]:
        """(tokens of the first, of the second, groups, groups as text, keys of the links) of each text."""
        cut = [self.units(t) if t else [] for t in texts]
        self.learn(cut)
        out, memo = [], self.memo
        for units in cut:
            found = [memo[u] for u in units]
            if not found or None in found:
                out.append((0, 0, 0, "", b""))
                continue
            n_a, n_b, groups, keys = zip(*found)
            links = b"".join(keys)
            out.append((sum(n_a), sum(n_b), len(links) // self.key.itemsize, ";".join(groups), links))
        return out


def key_type(n_first: int, n_second: int) -> np.dtype:
    """Type of a link's key, id of the first x size of the second + id of the second."""
    return np.dtype("<u4" if n_first * n_second <= 1 << 32 else "<u8")


_ALIGNERS: dict[tuple, Aligner] = {}


def _aligner(shared, memo_units: int) -> Aligner:
    """One aligner per worker process and pair of vocabularies."""
    key = (hash(shared.value), memo_units)
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(*shared.value, memo_units=memo_units)
    return _ALIGNERS[key]


ALIGNED = "row bigint, doc_id {id}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, links binary"


def aligned_texts(
    docs: DataFrame, first_path: str, second_path: str, id_col: str = "doc_id", text_col: str = "text",
    keep_groups: bool = False, memo_units: int = MEMO_UNITS,
) -> DataFrame:
    """One row per document: ``row`` (a number of its own), ``doc_id``,
    ``n_a``, ``n_b`` (tokens of space + text), ``n_groups``, ``groups_sha256``,
    ``links`` (binary: the key of the pair of tokens at the end of each
    group) and, with ``keep_groups``, ``groups`` as text
    (``a1,a2|b1;a3|b2,b3``).

    Null or empty text, and text that one of the tokenizers does not give back
    byte by byte, has no tokens: zeros, '' and no links.  Equal rows each give
    a row; an empty table gives an empty result; texts of any length are
    encoded whole.  The vocabulary files (some megabytes) are read on the
    driver and broadcast.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    with open(first_path, "rb") as f, open(second_path, "rb") as g:
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))
    schema = ALIGNED.format(id=docs.schema[id_col].dataType.simpleString()) + (", groups string" if keep_groups else "")
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        aligner = _aligner(shared, memo_units)
        for batch in batches:
            sizes = np.cumsum([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(2).cast(pa.binary())])
            start = 0
            while start < batch.num_rows:  # some megabytes of text at a time
                limit = (sizes[start - 1] if start else 0) + 4 * CALL_BYTES
                stop = max(start + 1, int(np.searchsorted(sizes, limit)))
                part = batch.slice(start, stop - start)
                found = aligner.texts(part.column(2).to_pylist())
                n_a, n_b, n_groups, groups, links = zip(*found)
                columns = [
                    part.column(0), part.column(1), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(n_groups, pa.int64()),
                    pa.array([hashlib.sha256(s.encode()).hexdigest() if s else "" for s in groups]),
                    pa.array(links, pa.binary()),
                ] + ([pa.array(groups)] if keep_groups else [])
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)
                start = stop

    rows = docs.select(F.monotonically_increasing_id().alias("row"), col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def pair_counts(aligned: DataFrame, key: np.dtype, held: int = 1_000_000) -> DataFrame:
    """(``key``, ``n``): links of each pair of ids in all documents.  A task
    adds up sorted runs of keys and sends them on when ``held`` are full."""
    import pyarrow as pa

    schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def add(keys, counts, more):
        new, first = np.unique(more, return_counts=True)
        both, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
        return both, np.bincount(at, np.concatenate([counts, first]), len(both)).astype(np.int64)

    def run(batches):
        keys, counts = np.empty(0, key), np.empty(0, np.int64)
        send = lambda: pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts)], schema=schema)
        for batch in batches:
            waiting, size = [], 0
            for i in range(batch.num_rows):
                links = batch.column(0)[i].as_buffer()
                waiting.append(np.frombuffer(links, key))
                size += len(waiting[-1])
                if size > held:
                    keys, counts = add(keys, counts, np.concatenate(waiting))
                    waiting, size = [], 0
            if waiting:
                keys, counts = add(keys, counts, np.concatenate(waiting))
            if len(keys) > held:
                yield send()
                keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield send()

    return aligned.select("links").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def align_tokenizers(
    docs: DataFrame,
    first_path: str,
    second_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_groups: bool = False,
    memo_units: int = MEMO_UNITS,
    pairs_per_block: int = PAIRS_PER_BLOCK,
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``,
    ``n_links`` (pairs of tokens that end at the same byte), ``n_best`` (links
    of a pair that no other pair of its second id exceeds in the whole
    table), ``count_sum`` (the table's count of each link's pair, summed),
    ``groups_sha256`` and, with ``keep_groups``, ``groups``.

    Every group ends with exactly one pair, so a link is kept as the key of
    its ids.  The counts of the pairs met grow with the vocabularies, not with
    the documents; they are broadcast in blocks of ``pairs_per_block``, each
    of which scans the links once, so any number of pairs is exact.  See
    ``aligned_texts`` for nulls, empty texts, repeats and empty tables.
    """
    import sentencepiece

    spark = docs.sparkSession
    n_second = sentencepiece.SentencePieceProcessor(model_file=second_path).get_piece_size()
    with open(first_path, "rb") as f:
        n_first = max(json.load(f)["model"]["vocab"].values()) + 1
    key = key_type(n_first, n_second)
    aligned = reliable(aligned_texts(docs, first_path, second_path, id_col, text_col, keep_groups, memo_units))
    counts = pair_counts(aligned, key)
    of_second = F.expr(f"key % {n_second}")
    counts = reliable(counts.withColumn("second", of_second))
    best = counts.groupBy("second").agg(F.max("n").alias("top"))  # at most the second vocabulary
    stats = reliable(counts.join(F.broadcast(best), "second").select("key", "n", (F.col("n") == F.col("top")).alias("best")))
    n_pairs = stats.count()
    blocks = max(1, -(-n_pairs // pairs_per_block))

    def looked_up(block: int) -> DataFrame:
        some = stats if blocks == 1 else stats.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block)
        found = some.orderBy("key").toArrow()
        shared = spark.sparkContext.broadcast(
            (found["key"].to_numpy().astype(key), found["n"].to_numpy(), found["best"].to_numpy(zero_copy_only=False))
        )

        def run(batches):
            import pyarrow as pa

            keys, n, best = shared.value
            for batch in batches:
                n_best, total = [], []
                for links in batch.column(batch.num_columns - 1):
                    asked = np.frombuffer(links.as_buffer(), key)
                    at = np.searchsorted(keys, asked)
                    if blocks > 1:
                        at = at[keys[np.minimum(at, len(keys) - 1)] == asked] if len(keys) else at[:0]
                    n_best.append(int(best[at].sum()))
                    total.append(int(n[at].sum()))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array(n_best, pa.int64()), pa.array(total, pa.int64())],
                    names=[*batch.schema.names[:-1], "n_best", "count_sum"],
                )

        own = ["row"] if blocks > 1 else [c for c in aligned.columns if c != "links"]
        types = ", ".join(f"{c} {aligned.schema[c].dataType.simpleString()}" for c in own)
        return aligned.select(*own, "links").mapInArrow(run, f"{types}, n_best bigint, count_sum bigint")

    if blocks == 1:
        out = looked_up(0)
    else:
        parts = [reliable(looked_up(b)) for b in range(blocks)]
        total = parts[0]
        for p in parts[1:]:
            total = total.unionByName(p)
        total = total.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        out = aligned.drop("links").join(total, "row")
    return out.select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256",
        *(["groups"] if keep_groups else []),
    )
