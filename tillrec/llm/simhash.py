"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint has a bit where more than half of its shingles' 64-bit
hashes have it.  Fingerprints link at ``radius`` or fewer differing bits.

To find all links, every bit position gets a non-zero vector of radius + 1
bits, and for each of the 2^(radius+1) - 1 non-zero vectors v there is a
table keyed by the bits whose vector has odd inner product with v.  The
vectors of up to ``radius`` differing bits span too little to fill the space,
so some v is orthogonal to all of them: in its table the differing bits are
masked out and the pair collides.  Every link is found, with no chance
involved.  Tables hold distinct fingerprints; colliding ones are compared
inside their bucket, and only a spanning forest of each bucket's links goes
on to the connected components.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillrec.llm.common import col, map_rows, reliable

BITS = 64
#: Shingles hashed at a time, and bytes of text normalised at a time.
BLOCK_SHINGLES = 1 << 16
BLOCK_BYTES = 1 << 20
#: Fingerprints of one bucket compared by one task; larger buckets are cut into cells of two such parts.
BUCKET_ROWS = 2048


def _word_blocks(data: bytes):
    """Words of a text, in lists, a block of bytes at a time."""
    at = 0
    while at < len(data):
        end = at + BLOCK_BYTES
        if end >= len(data):
            yield data[at:].split()
            return
        stops = [p for p in (data.find(c, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if p >= 0]
        end = min(stops, default=len(data))
        yield data[at:end].split()
        at = end


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """SimHash over XXH64 of word shingles, repeats included; 0 without words."""
    from xxhash import xxh64_intdigest

    votes, n, held = np.zeros(BITS, np.int64), 0, []

    def vote(hashes: list[int]) -> None:
        nonlocal votes, n
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        if whole:
            votes += np.add.reduce(bits[:whole].reshape(-1, 255, BITS), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        votes += bits[whole:].sum(axis=0, dtype=np.int64)
        n += len(hashes)

    for words in _word_blocks((text or "").encode("utf-8", "surrogatepass").lower()):
        words = held + words
        joined = b" ".join(words)
        ends, starts, at = [], [], 0
        for w in words:
            starts.append(at)
            at += len(w)
            ends.append(at)
            at += 1
        for k in range(0, max(0, len(words) - shingle + 1), BLOCK_SHINGLES):
            stop = min(k + BLOCK_SHINGLES, len(words) - shingle + 1)
            vote([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[k:stop], ends[k + shingle - 1 : stop + shingle - 1])])
        held = words[-(shingle - 1) :] if shingle > 1 else []
        if len(words) < shingle:
            held = words
    if not n:
        if not held:
            return 0
        vote([xxh64_intdigest(b" ".join(held), seed)])
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``digest`` (MD5 of the text) and ``fp`` (the 64 bits as a signed long) of every row."""

    def make():
        def one(doc_id, text, digest):
            f = fingerprint(text, shingle)
            return doc_id, digest, f - (1 << 64) if f >> 63 else f

        return one

    kind = docs.schema[id_col].dataType.simpleString()
    digest = F.md5(F.encode(F.coalesce(col(text_col), F.lit("")), "UTF-8"))
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"), digest.alias("digest"))
    return map_rows(rows, make, f"doc_id {kind}, digest string, fp bigint")


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """One mask for each non-zero vector v of radius + 1 bits: the bit
    positions whose own vector (1, 2, ... in turn) has odd product with v."""
    top = (1 << (radius + 1)) - 1
    own = [i % top + 1 for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (own[i] & v).bit_count() & 1) for v in range(1, top + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Index pairs of a spanning forest of the links among distinct fingerprints."""
    left = np.arange(len(fps))
    out: list[tuple[int, int]] = []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            some, front = front[:256], front[256:]
            near = np.bitwise_count(fps[some][:, None] ^ fps[left][None, :]) <= radius
            got = near.any(axis=0)
            if got.any():
                out += zip(some[near[:, got].argmax(axis=0)].tolist(), left[got].tolist())
                front = np.concatenate([front, left[got]])
                left = left[~got]
    return out


def links(distinct: DataFrame, radius: int = 4, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges (a, b) whose connected components are those of all links among
    the distinct fingerprints in column ``fp``."""
    masks = covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks)])
    rows = distinct.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.key")
    shared = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / bucket_rows).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    cells = (
        rows.join(shared, ["t", "key"])
        .withColumn("parts", parts)
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("t", "key", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "fp")
    )
    dealt = cells.repartition("t", "key", "p", "q").sortWithinPartitions("t", "key", "p", "q", "fp")

    def compare(batches):
        import pyarrow as pa

        held = None

        def of(block):
            """Edges of whole buckets, given as sorted columns."""
            heads, fps = block
            new = np.ones(len(fps), bool)
            new[1:] = (heads[1:] != heads[:-1]).any(axis=1)
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(fps)))
            a, b = [], []
            small = np.repeat(size <= 8, size)
            last = np.repeat(start + size, size)
            for d in range(1, int(size[size <= 8].max(initial=1))):
                i = np.flatnonzero(small & (np.arange(len(fps)) + d < last))
                i = i[np.bitwise_count(fps[i] ^ fps[i + d]) <= radius]
                a.append(fps[i])
                b.append(fps[i + d])
            for s, m in zip(start[size > 8].tolist(), size[size > 8].tolist()):
                pairs = np.array(forest(fps[s : s + m], radius), dtype=np.int64).reshape(-1, 2)
                a.append(fps[s + pairs[:, 0]])
                b.append(fps[s + pairs[:, 1]])
            x, y = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
            edges = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            heads = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)], axis=1)
            fps = batch.column(4).to_numpy(zero_copy_only=False).view(np.uint64)
            if held is not None:
                heads, fps = np.concatenate([held[0], heads]), np.concatenate([held[1], fps])
            cut = int(np.flatnonzero((heads != heads[-1]).any(axis=1))[-1]) + 1 if (heads != heads[-1]).any() else 0
            if cut:
                yield of((heads[:cut], fps[:cut]))
            held = heads[cut:], fps[cut:]
        if held is not None:
            yield of(held)

    return dealt.mapInArrow(compare, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the smallest
    node of its connected component.  Large-star and small-star steps in turn,
    each round written to the checkpoint folder, until nothing changes."""

    def mark(df):
        return df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()

    edges = reliable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    was = mark(edges)
    while was[0]:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        edges = reliable(small.where("a <> b").distinct())
        now = mark(edges)
        if now == was:
            break
        was = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def rooted(docs: DataFrame, shingle: int, radius: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, digest, fp), and the component root of every distinct fp."""
    rows = reliable(fingerprints(docs, shingle, id_col, text_col))
    distinct = reliable(rows.select("fp").distinct())
    tree = components(links(distinct, radius))
    roots = distinct.join(tree.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return rows, roots


def simhash_components(docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``fp`` and ``component_id``, the
    smallest id that links of at most ``radius`` differing bits lead to.

    Null, empty and wordless texts have fingerprint 0 and link like any other;
    a text of fewer words than a shingle is one shingle; equal texts share a
    fingerprint and so a component; rows without id take part and get the
    smallest id of their component (null if it has none); repeated rows are
    all kept; an empty table gives an empty result.
    """
    rows, roots = rooted(docs, shingle, radius, id_col, text_col)
    low = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    joined = roots.join(low, "fp")
    least = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    of = joined.join(least, "root").select("fp", "component_id")
    return rows.join(of, "fp").select("doc_id", "fp", "component_id")


def simhash_digest(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """Document, fingerprint as 16 hex digits, component."""
    return simhash_components(docs, shingle, radius).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every component, as it was: the one with the smallest id
    (nulls last), of rows with one id the one with the smallest text digest,
    of equal rows any one."""
    rows, roots = rooted(docs, shingle, radius, id_col, text_col)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest").alias("first")
    best = rows.groupBy("fp").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = roots.join(best, "fp").groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.digest")
    firsts = reliable(firsts)
    keyed = docs.withColumns({"__id": col(id_col), "__digest": F.md5(F.encode(F.coalesce(col(text_col), F.lit("")), "UTF-8"))})

    def of(keys: DataFrame, how: str, df: DataFrame) -> DataFrame:
        return df.join(keys, df["__id"].eqNullSafe(keys["doc_id"]) & (df["__digest"] == keys["digest"]), how)

    # rows that are equal in id and text: only these need a further shuffle of their texts
    again = reliable(rows.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    kept = of(firsts, "left_semi", keyed)
    single = of(again, "left_anti", kept)
    several = of(again, "left_semi", kept).dropDuplicates(["__id", "__digest"])
    return single.union(several).select(*[col(c) for c in docs.columns])
