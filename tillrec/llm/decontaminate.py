"""Benchmark decontamination with one Aho-Corasick automaton.

Items are lower-cased and cut into words; every run of ``window`` words of an
item (the whole item, if shorter) is a pattern of one automaton over word
numbers.  A text is normalised the same way and scanned once; each match end
gives the window's words, and byte positions of the words lead back to code
points of the original text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillrec.llm.common import col, map_rows, reliable

#: ASCII letters and digits and all bytes above ASCII make words; A-Z counts as a-z.
FOLD = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
#: Automaton nodes of one pass (some hundred bytes each); a larger benchmark is scanned for in blocks.
MAX_NODES = 2_000_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def windows_of(words: list[bytes], window: int) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[k : k + window]) for k in range(max(1, len(words) - window + 1))]


class Scanner:
    """The automaton over the windows of some items, given as (item number, words)."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int):
        import ahocorasick

        owners: dict[tuple[bytes, ...], set[int]] = {}
        for number, words in items:
            for w in windows_of(words, window):
                owners.setdefault(w, set()).add(number)
        self.number: dict[bytes, int] = {}
        for w in owners:
            for word in w:
                self.number.setdefault(word, len(self.number) + 1)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for w, own in owners.items():
            self.automaton.add_word(tuple(self.number[x] for x in w), (len(w), tuple(own)))
        if owners:
            self.automaton.make_automaton()
        self.any = bool(owners)

    def find(self, words: list[bytes]) -> tuple[list[int], list[int], set[int]]:
        """Word runs hit (starts and ends, merged) and the items that own a matching window."""
        starts: list[int] = []
        ends: list[int] = []
        items: set[int] = set()
        if self.any and words:
            number = self.number.get
            for end, (length, own) in self.automaton.iter(tuple([number(w, 0) for w in words])):
                start = end + 1 - length
                while starts and starts[-1] >= start:  # a longer window may begin before earlier ones
                    starts.pop()
                    end = max(end, ends.pop() - 1)
                if starts and start <= ends[-1]:
                    ends[-1] = max(ends[-1], end + 1)
                else:
                    starts.append(start)
                    ends.append(end + 1)
                items.update(own)
        return starts, ends, items


def char_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point spans of word runs [a, b) in the original text."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    is_word = np.frombuffer(data.tobytes().translate(FOLD), np.uint8) != 32
    edge = np.diff(np.concatenate([[0], is_word.view(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return [(int(chars[begin[a]]), int(chars[end[b - 1]])) for a, b in runs]


_SCANNER: list = [None, 0, None]


def _scanner(shared, window: int) -> Scanner:
    """One automaton per worker process, kept as long as its items are the same object."""
    if _SCANNER[0] is not shared.value or _SCANNER[1] != window:
        _SCANNER[:] = [shared.value, window, Scanner(shared.value, window)]
    return _SCANNER[2]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    max_nodes: int = MAX_NODES,
    carry: bool = False,
) -> DataFrame:
    """One row per document: id, ``n_words``, ``n_hit`` (words inside any
    occurrence of a window), ``items`` (sorted item ids, as text, with an
    occurring window), ``spans`` (code-point start and end of each run of
    hit words in the original text).  With ``carry`` the columns of ``docs``
    come first and only ``n_words``, ``n_hit``, ``items`` and ``spans`` are added.

    The benchmark is the stated query set: it is read in blocks of at most
    ``max_nodes`` window words, each broadcast as words; texts are scanned once
    for each block (one, below that size).  Null texts have no words; null or
    wordless items have no windows; an item without id is hit but not listed;
    an item id in several rows counts once; empty tables give empty results or
    no hits.
    """
    sc = docs.sparkSession.sparkContext
    names = docs.columns if carry else [id_col]
    base = docs.select(*[col(c) for c in names], *([] if carry else [col(text_col)]))
    if not carry and id_col == text_col:
        raise ValueError("the id and the text are one column")
    at = base.columns.index(text_col)
    kept = [f for f in base.schema.fields if carry or f.name != text_col]
    sql = lambda f: f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}"
    found = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,end:bigint>>"
    clash = {"n_words", "n_hit", "items", "spans"} & {f.name.lower() for f in kept}
    if clash:
        raise ValueError(f"rename {sorted(clash)} of the documents first")

    n_base = len(base.columns)
    dropped = None if carry else at

    def scan(df: DataFrame, shared, ids: list[str | None], has: bool, last: bool) -> DataFrame:
        def make():
            scanner = _scanner(shared, window)

            def one(*row):
                text = row[at]
                words = words_of(text)
                starts, ends, items = scanner.find(words)
                runs = list(zip(starts, ends))
                own = {ids[k] for k in items if ids[k] is not None}
                if has:  # add what earlier blocks found, kept as word runs
                    own |= set(row[-2])
                    runs = merge_runs([*runs, *((r["start"], r["end"]) for r in row[-1])])
                hit = sum(b - a for a, b in runs)
                out = row[:n_base]
                if last:
                    runs = char_spans(text, runs) if runs else []
                    out = tuple(x for k, x in enumerate(out) if k != dropped)
                return (*out, len(words), hit, sorted(own), [{"start": a, "end": b} for a, b in runs])

            return one

        source = df.select(*[col(c) for c in base.columns], *(["items", "spans"] if has else []))
        fields = kept if last else base.schema.fields
        long = carry or not last
        return map_rows(source, make, ", ".join(map(sql, fields)) + ", " + found, weigh=lambda r: len(r[at] or "") if long else 64)

    shared, block, ids, nodes = [], [], [], 0
    for r in benchmark.select(col(item_col).cast("string").alias("i"), col(text_col).alias("t")).toLocalIterator():
        words = words_of(r["t"])
        size = len(words) * window
        if nodes and nodes + size > max_nodes:
            shared.append(sc.broadcast(block))
            block, nodes = [], 0
        block.append((len(ids), words))
        ids.append(r["i"])
        nodes += size
    shared.append(sc.broadcast(block))
    out = scan(base, shared[0], ids, False, len(shared) == 1)
    for k, more in enumerate(shared[1:], 2):
        out = scan(reliable(out), more, ids, True, k == len(shared))
    return out


def merge_runs(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching runs joined, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contamination_digest(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Per document: words, hit words, items found and the SHA-256 of their ids."""
    found = find_contamination(docs, benchmark, window)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents without any occurrence of a benchmark window, as they were."""
    plain = docs.select(*[col(c).alias(f"__{k}") for k, c in enumerate(docs.columns)])
    text = f"__{docs.columns.index('text')}"
    ident = f"__{docs.columns.index('doc_id')}"
    found = find_contamination(plain, benchmark.select("item_id", F.col("text").alias(text)), window, ident, text, carry=True)
    return found.where("n_hit = 0").select(*[F.col(f"__{k}").alias(c) for k, c in enumerate(docs.columns)])
