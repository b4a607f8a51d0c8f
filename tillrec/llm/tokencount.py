"""Exact token counts at every prefix of a text, by dynamic programming.

A byte-pair encoding has this property: tokens t1 .. tn are the encoding of
their bytes exactly if every two neighbours are the encoding of theirs.  So
the last token of a prefix's encoding is the one token that ends there and
agrees with the last token of the prefix before it, and

    count[i] = count[i - len(last[i])] + 1

gives the count at every prefix in one pass.  The pass runs over units of the
pre-tokenizer (white space and the word, number or sign run behind it), whose
counts do not depend on their neighbours, and is remembered per distinct unit.

What is stored per text is the change of the count from each code point to
the next, one signed byte each; the running sum is the exact token count of
every prefix, which answers truncation and budget questions without encoding
anything again.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillrec.llm.common import col, map_rows

CONTRACTION = "'(?:s|t|re|ve|m|ll|d)"
WS = r"\p{White_Space}"
#: White space with what follows; a contraction takes no space before it.
UNIT = regex.compile(
    rf"(?:{WS}*[^\P{{White_Space}} ])?{CONTRACTION}|{WS}*(?:\p{{L}}+|\p{{N}}+|[^{WS}\p{{L}}\p{{N}}]+)|{WS}+"
)
#: The same for texts of Latin characters on whose classes the plain module agrees.
PLAIN_UNIT = re.compile(rf"(?:\s*[^\S ])?{CONTRACTION}|\s*(?:[^\W\d_]+|\d+|(?:[^\w\s]|_)+)|\s+")
NOT_PLAIN = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbeɐ-\U0010ffff]")
CHUNK_CHARS = 1 << 20
#: Entries that a worker remembers: units (two generations of so many) and token pairs.
MEMO_UNITS = 400_000
MEMO_PAIRS = 2_000_000


def byte_letters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for:
    printable Latin-1 characters for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class PrefixCounter:
    """Prefix token counts of texts under one byte-level vocabulary file (its bytes)."""

    def __init__(self, vocabulary: bytes):
        spec = json.loads(vocabulary)
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: as_bytes(t) for t, i in vocab.items()}
        self.ids: dict[bytes, int] = {b: i for i, b in self.bytes_of.items()}
        self.trie: dict[bytes, int] = {}
        for b in self.ids:
            for k in range(1, len(b)):
                self.trie.setdefault(b[:k], -1)
        self.trie |= self.ids
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.parts = {new: (pair, rank) for pair, (rank, new) in self.merges.items()}
        self.agree: dict[tuple[int, int], bool] = {}
        self.edges: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stand at one edge of ``token`` while it is merged
        (side 1: its end, 0: its start), each with the rank of the merge that
        takes it in (infinite for the token itself)."""
        known = self.edges.get((token, side))
        if known is None:
            known, taken_in, t = [], float("inf"), token
            while True:
                known.append((t, taken_in))
                if t not in self.parts:
                    break
                pair, taken_in = self.parts[t]
                t = pair[side]
            self.edges[token, side] = known
        return known

    def agrees(self, a: int, b: int) -> bool:
        """Whether b may follow a (a = -1: b begins the piece): no merge across
        the border is due while both of its parts still stand there.  Of two
        equal pairs the left one is merged first."""
        known = self.agree.get((a, b))
        if known is None:
            merges, known = self.merges, True
            if a >= 0:
                left = self.edge(b, 0)
                known = not any(
                    (m := merges.get((x, y))) and m[0] < x_until and m[0] <= y_until
                    for x, x_until in self.edge(a, 1)
                    for y, y_until in left
                )
            if len(self.agree) >= MEMO_PAIRS:
                self.agree.clear()
            self.agree[a, b] = known
        return known

    def byte_prefixes(self, piece: bytes) -> list[int]:
        """count[i] of the first i bytes of one pre-token, i = 0 .. len."""
        n, trie, agree = len(piece), self.trie, self.agree
        count, last = [0] * (n + 1), [-1] * (n + 1)
        for j in range(n):
            before, c = last[j], count[j] + 1
            for k in range(j + 1, n + 1):
                t = trie.get(piece[j:k])
                if t is None:
                    break
                if t >= 0 and not count[k]:
                    ok = agree.get((before, t))
                    if ok or ok is None and self.agrees(before, t):
                        count[k], last[k] = c, t
        return count

    def char_prefixes(self, piece: str) -> list[int]:
        """Counts after each code point of one pre-token."""
        data = piece.encode("utf-8", "surrogatepass")
        count = self.byte_prefixes(data)
        if len(data) == len(piece):
            return count[1:]
        ends = np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in piece])
        return [count[e] for e in ends]

    def unit_prefixes(self, unit: str) -> list[int]:
        """Counts after each code point of a unit.  White space before a word is
        one pre-token while the text ends in it; once the word begins, its
        last character goes to the word (a space) or stands alone."""
        plain = unit.isascii() and unit.isprintable() or not NOT_PLAIN.search(unit)
        body = unit.lstrip() if plain else regex.sub(rf"^{WS}+", "", unit)
        k = len(unit) - len(body)
        if body[:1] == "'" and regex.fullmatch(CONTRACTION, body):
            out = self.char_prefixes(unit[:k]) if k else []
            base = self.spaces(unit[:k])
            for j in range(1, len(body) + 1):
                part = body[:j]
                pieces = [part] if j == len(body) or j == 1 else [part[:1], part[1:]]
                if j > 1 and j < len(body) and regex.fullmatch(CONTRACTION, part):
                    pieces = [part]
                out.append(base + sum(self.char_prefixes(p)[-1] for p in pieces))
            return out
        if not body:
            return self.char_prefixes(unit)
        if not k:
            return self.char_prefixes(body)
        out = self.char_prefixes(unit[:k])
        if unit[k - 1] == " ":
            head = self.char_prefixes(unit[: k - 1])[-1] if k > 1 else 0
            return out + [head + c for c in self.char_prefixes(" " + body)[1:]]
        return out + [self.spaces(unit[:k]) + c for c in self.char_prefixes(body)]

    def spaces(self, run: str) -> int:
        """Tokens of a white-space run that something other than a space-taking word follows."""
        return sum(self.char_prefixes(p)[-1] for p in (run[:-1], run[-1:]) if p)

    def unit_changes(self, unit: str) -> bytes:
        known = self.older.get(unit) or self.memo.get(unit)
        if known is None:
            before, out = 0, bytearray()
            for c in self.unit_prefixes(unit):
                out.append((c - before) & 255)
                before = c
            known = bytes(out)
        if len(unit) <= 64:  # longer ones hardly repeat
            if len(self.memo) >= MEMO_UNITS:
                self.older, self.memo = self.memo, {}
            self.memo[unit] = known
        return known

    def units(self, text: str):
        """The units of a text, in lists, a chunk at a time."""
        find = (UNIT if NOT_PLAIN.search(text) else PLAIN_UNIT).findall
        at, step = 0, CHUNK_CHARS
        while at < len(text):
            found = find(text, at, at + step)
            if at + step < len(text):
                cut = found.pop()  # may go on behind the chunk
                while found and (len(cut) < 4 or not cut.strip()):  # so may its white space, or a contraction
                    cut = found.pop() + cut
                if not found:
                    step *= 2
                    continue
                at += step - len(cut)
                step = CHUNK_CHARS
            else:
                at = len(text)
            yield found

    def plain_changes(self, text: str) -> bytes:
        miss = self.unit_changes
        return b"".join([b"".join([get(u) or miss(u) for u in units]) for units in self.units(text) for get in [self.memo.get]])

    def changes(self, text: str) -> bytes:
        """Change of the token count with each code point of the text; special
        strings are one token each, as the library has them by default."""
        found = list(self.special.finditer(text)) if self.special else []
        if not found:
            return self.plain_changes(text)
        out, at = [], 0
        for m in found:
            part = self.plain_changes(text[at : m.start()])
            out.append(part)
            total = int(np.frombuffer(part, np.int8).sum())
            # until its last character the special string is plain text behind the part's last unit
            tail = text[at : m.start()]
            keep = 0
            for units in self.units(tail):
                keep = len(units[-1]) + (len(units[-2]) if len(units) > 1 else 0)
            joined = self.plain_changes(tail[len(tail) - keep :] + m[0][:-1])
            here = np.frombuffer(joined, np.int8).astype(int)
            inside = here[keep:].copy()
            was = int(np.frombuffer(part, np.int8)[len(part) - keep :].sum()) if keep else 0
            inside[0] += int(here[:keep].sum()) - was
            last = total + 1 - (total + int(inside.sum()))
            out.append(np.array([*inside, last]).astype(np.int8).tobytes())
            at = m.end()
        out.append(self.plain_changes(text[at:]))
        return b"".join(out)


_COUNTERS: dict[int, PrefixCounter] = {}


def _counter(shared) -> PrefixCounter:
    """One counter per worker process and vocabulary."""
    key = hash(shared.value)
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = PrefixCounter(shared.value)
    return _COUNTERS[key]


def prefix_token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_bytes`` (UTF-8), ``n_tokens`` and
    ``prefix`` (binary: one signed byte per code point, the change of the
    exact token count there).

    Null text counts as empty (0 bytes, 0 tokens, empty prefix); equal rows
    each give a row; an empty table gives an empty result; long texts are
    worked through in chunks.  The vocabulary file (one or two megabytes) is
    read on the driver and broadcast.
    """
    with open(vocabulary_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        counter = _counter(shared)

        def one(doc_id, text):
            changes = counter.changes(text or "")
            return doc_id, len((text or "").encode()), int(np.frombuffer(changes, np.int8).sum(dtype=np.int64)), changes

        return one

    id_type = docs.schema[id_col].dataType.simpleString()
    return map_rows(
        docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")),
        make,
        f"doc_id {id_type}, n_bytes bigint, n_tokens bigint, prefix binary",
        weigh=lambda row: len(row[3]),
    )


def counts_from_prefix(prefix: bytes) -> np.ndarray:
    """Token count of every prefix, 0 .. all code points."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(prefix or b"", np.int8), dtype=np.int64)])


def _chars_within(prefix: bytes, budget: int) -> int:
    return int(np.flatnonzero(counts_from_prefix(prefix) <= budget)[-1])


def chars_within_budget(counts: DataFrame, budget: int) -> DataFrame:
    """Adds ``n_chars_within``: the longest prefix, in code points, whose
    encoding has at most ``budget`` tokens, and ``tokens_within``, its count.
    Reads the stored counts only."""
    @F.pandas_udf("n_chars_within bigint, tokens_within bigint")
    def within(prefix: pd.Series) -> pd.DataFrame:
        chars = [_chars_within(p, budget) for p in prefix]
        return pd.DataFrame({"n_chars_within": chars, "tokens_within": [int(counts_from_prefix(p)[c]) for p, c in zip(prefix, chars)]})

    return counts.withColumn("__w", within("prefix")).select(*[col(c) for c in counts.columns], "__w.n_chars_within", "__w.tokens_within")


def token_digest(docs: DataFrame, vocabulary_path: str, limit: int = 1024) -> DataFrame:
    """Counts of whole texts and whether they exceed ``limit``, from the stored prefixes."""
    return prefix_token_counts(docs, vocabulary_path).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
