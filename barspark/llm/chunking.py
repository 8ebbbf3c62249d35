"""Document fingerprints by content-defined chunking.

A gear hash rolls over the bytes of a text; a chunk ends where the hash meets a mask, so an insertion moves only
the boundaries near it. Chunking is normalised: below the normal size a stricter mask must match and above it a
looser one, which narrows the spread of sizes. The set of chunk digests, each weighted by its length, is the
fingerprint; containment is the share of one text's bytes that lie in chunks of the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barspark.llm.storage import attached, documents, saved
from barspark.llm.textbytes import span_hashes

#: Bytes of a chunk. The looser mask has 5 bits and the stricter 7, so that most chunks are close to NORMAL.
LEAST, NORMAL, MOST = 16, 64, 256
LOOSE, STRICT = np.uint32(0xF8000000), np.uint32(0xFE000000)
GEAR = np.random.Generator(np.random.PCG64(77)).integers(0, 2**32, 256, dtype=np.uint32)


def gear_hashes(buf: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte, h = 2 h + GEAR[byte] modulo 2**32, by doubling: it spans 32 bytes."""
    h = GEAR[buf]
    reach = 1
    while reach < 32 and reach < len(h):
        longer = h.copy()
        longer[reach:] += h[:-reach] << np.uint32(reach)
        h, reach = longer, reach * 2
    return h


def boundaries(buf: np.ndarray) -> list[int]:
    """Ends of the chunks of one text."""
    n = len(buf)
    if n <= LEAST:
        return [n] if n else []
    h = gear_hashes(buf)
    at = np.flatnonzero((h & LOOSE) == 0)
    strict = ((h[at] & STRICT) == 0).tolist()
    ends, last, at = [], 0, (at + 1).tolist()
    for end, both in zip(at, strict, strict=True):
        while end - last > MOST:
            last += MOST
            ends.append(last)
        size = end - last
        if size >= NORMAL or (both and size >= LEAST):
            ends.append(end)
            last = end
    while n - last > MOST:
        last += MOST
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def chunk_digests(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit digests of a text's chunks, and the bytes that each stands for (repeats counted)."""
    buf = np.frombuffer(data, np.uint8)
    ends = np.array(boundaries(buf), np.int64)
    if not len(ends):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    starts = np.concatenate(([0], ends[:-1]))
    digests, which = np.unique(span_hashes(buf, starts, ends), return_inverse=True)
    return digests, np.bincount(which, weights=ends - starts).astype(np.int64)


def containment(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Share of the smaller text's bytes in chunks that both have; two empty texts have 1, one empty text 0."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum()
    return float(shared / min(a[1].sum(), b[1].sum()))


def written(prints: tuple[np.ndarray, np.ndarray]) -> str:
    """digest:bytes of each chunk, in hex and comma-joined, in order of the digests."""
    return ",".join(f"{d:016x}:{n:x}" for d, n in zip(prints[0].tolist(), prints[1].tolist(), strict=True))


def edited(text: str, following: str) -> str:
    """text with its last third (rounded down, in code points) replaced by as many first ones of following, or all."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, n_chunks long"
)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, str | None]]:
    """doc_id, text and the following text of the rows of a partition, which is sorted by block and place.

    The last row of a block is the first of the next block, borrowed.
    """
    before = None
    for batch in batches:
        for block, borrowed, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("_block", "_borrowed", "doc_id", "text")), strict=True):
            text = text or ""
            if before and before[0] == block:
                yield before[1], before[2], text
            before = None if borrowed else (block, doc_id, text)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_chunks"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    rows: list[tuple] = []
    kept: tuple[str, tuple] = ("", chunk_digests(b""))
    size = 0
    for doc_id, text, following in _pairs(batches):
        own = kept[1] if kept[0] == text else chunk_digests(text.encode())
        after = own if following == text else chunk_digests(following.encode())
        kept = (following, after)
        new = edited(text, following).encode()
        changed = chunk_digests(new)
        rows.append((doc_id, len(text), hashlib.sha256(new).hexdigest(), written(own), written(changed), containment(own, changed), containment(own, after), int(own[1].size)))
        size += len(new)
        if size > 1 << 21:
            yield batch(rows)
            rows, size = [], 0
    if rows:
        yield batch(rows)


#: A level of bounds has at most so many ranges, and a table at most so many tasks.
RANGES, MOST_TASKS = 1_000, 100_000


def fingerprints(docs: DataFrame, block_rows: int = 2_000, ranges: int = RANGES) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_chunks.

    Null and empty texts have the empty fingerprint. The next document is the one with the next lower doc_id (equal
    ids, a null counting as the lowest, by the text's hash; rows equal in both are interchangeable), after the last the first. A single row follows itself. An
    empty table gives an empty result; other columns are ignored.

    Documents are dealt to blocks of about block_rows by two levels of bounds, so up to ranges squared blocks: quantiles of doc_id, and
    quantiles within each range of those. An id that fills blocks is parted by the text's hash, and a text that does by row. Texts are
    shuffled once; the first text of a block also goes to the block before, as the one that follows its last.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_at"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = docs.count()
    if not n:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    blocks = -(-n // block_rows)
    docs = docs.withColumn("_hash", _hash())
    dealt = _dealt(docs, blocks, block_rows, ranges)
    # A row a block, at most ranges squared of them, in the order of blocks.
    firsts = dealt.groupBy("_block").agg(F.max(F.struct("_at", "_hash")).alias("first"))
    before = F.coalesce(F.lag("_block").over(Window.orderBy("_block")), F.max("_block").over(Window.partitionBy()))
    heads = saved(firsts.select("first._at", "first._hash", before.alias("_to")), "chunking-heads")
    # A row that repeats is lent once.
    lent = attached(docs, heads, ["_at", "_hash"]).dropDuplicates(["_to"])
    columns = ["_at", "_hash", "doc_id", "text"]
    rows = dealt.select("_block", F.lit(False).alias("_borrowed"), *columns).union(lent.select("_to", F.lit(True), *columns))
    rows = rows.repartition(min(blocks, MOST_TASKS), "_block").sortWithinPartitions("_block", "_borrowed", F.desc("_at"), F.desc("_hash"))
    return rows.select("_block", "_borrowed", "doc_id", "text").mapInArrow(_fingerprints, SCHEMA)


def _hash() -> Column:
    """52 bits of a text's hash, as a double holds them all."""
    return F.shiftright(F.xxhash64("text"), 12)


def _quantiles(rows: DataFrame, value: str, n: int) -> list[float]:
    """n - 1 bounds of n parts with like numbers of rows, falling; a value that fills parts occurs as often."""
    shares = [k / n for k in range(1, n)]
    return sorted(rows.agg(F.percentile_approx(value, shares, 10 * n)).first()[0], reverse=True) if n > 1 else []


def _dealt(rows: DataFrame, blocks: int, block_rows: int, ranges: int) -> DataFrame:
    """rows (_at, _hash ...) with _block, whose order is that of falling _at, then falling _hash.

    Quantiles are of doubles, so bounds are those of ids rounded to doubles, which keeps their order.
    """
    coarse = min(ranges, -(-blocks // ranges))
    fine = min(ranges, -(-blocks // coarse))
    rows = rows.withColumn("_near", F.col("_at").cast("double"))
    edges = F.array(*(F.lit(b) for b in _quantiles(rows.select("_near"), "_near", coarse))) if coarse > 1 else F.array().cast("array<double>")
    rows = rows.withColumn("_coarse", _over(edges, F.col("_near")))
    shares = F.array(*(F.lit(k / fine) for k in range(1, fine))) if fine > 1 else None
    inner = F.sort_array(F.percentile_approx("_near", shares, F.lit(10 * fine)), asc=False) if fine > 1 else F.array().cast("array<double>")
    bounds = saved(rows.groupBy("_coarse").agg(inner.alias("_edges")), "chunking-bounds")
    # An id in more than one bound fills blocks: it is parted by quantiles of the text's hash.
    filled = bounds.select(F.explode("_edges").alias("_near")).groupBy("_near").agg(F.count("*").alias("_n")).where("_n > 1").select("_near")
    within = attached(rows.select("_near", "_at", "_hash"), saved(filled, "chunking-filled"), ["_near"])
    most = within.groupBy("_near").count().agg(F.max("count")).first()[0] or 0
    n_parts = max(2, min(ranges, -(-most // block_rows)))
    shares = F.array(*(F.lit(k / n_parts) for k in range(1, n_parts)))
    hashes = F.sort_array(F.percentile_approx("_hash", shares, F.lit(10 * n_parts)), asc=False).alias("_hashes")
    parts = within.groupBy("_near").agg(hashes, (F.min("_at") == F.max("_at")).alias("_one")).where("_one").drop("_one")
    rows = attached(attached(rows, bounds, ["_coarse"]), saved(parts, "chunking-parts"), ["_near"], "left")
    # Rows of one hash that is several bounds are alike: any order of them is right, so they are dealt by number.
    over = _over(F.col("_hashes"), F.col("_hash"))
    same = _over(F.col("_hashes"), F.col("_hash"), strict=False) - over
    part = over + F.when(same > 1, F.pmod(F.xxhash64(F.monotonically_increasing_id()), same)).otherwise(0)
    # Falling _at: an id that fills blocks comes after those over it, which share its place among the bounds.
    at = _over(F.col("_edges"), F.col("_near")).cast("long") * 2 + F.col("_hashes").isNotNull().cast("int")
    number = (F.col("_coarse").cast("long") * 4096 + at) * 4096 + F.coalesce(part, F.lit(0))
    return rows.withColumn("_block", number).drop("_coarse", "_edges", "_hashes", "_near")


def _over(edges: Column, value: Column, strict: bool = True) -> Column:
    """How many of the falling edges are over value (or, if not strict, at it or over it), by binary search."""
    start = F.struct(F.lit(0).alias("low"), F.size(edges).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"], 1)
        edge = F.get(edges, middle)
        more = (edge > value) if strict else (edge >= value)
        narrowed = F.struct(F.when(more, middle + 1).otherwise(s["low"]).alias("low"), F.when(more, s["high"]).otherwise(middle).alias("high"))
        return F.when(s["low"] >= s["high"], s).otherwise(narrowed)

    return F.aggregate(F.sequence(F.lit(1), F.lit(RANGES.bit_length() + 1)), start, halve, lambda s: s["low"])


def op8_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fingerprints() of all documents."""
    return fingerprints(documents(spark, sf_dir))
