"""Quality classification with a convolutional network over bytes, in numpy.

Bytes are embedded, filters of WIDTH bytes slide over the whole text, and their outputs are max-pooled over chunks
of two blocks that overlap by one, so that no byte is left out and no boundary hides a pattern. What the chunks
hold is combined by mean, maximum and minimum, and a logistic layer gives one probability. Embedding
and filters are learnt by back-propagation through the maxima; for scoring they fold into one table a filter position,
so that a convolution is WIDTH look-ups a byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.llm.sampling import fold, lowest, within_bytes
from barspark.llm.storage import documents
from barspark.llm.textbytes import slices

#: The bound of the training sample: about so many labelled texts of each label.
SAMPLE_PER_LABEL, SAMPLE_BYTES = 1_000, 32 << 20
WIDTH, DEPTH, FILTERS, BLOCK = 6, 8, 16, 64
EPOCHS, BATCH_BYTES, RATE, DECAY = 8, 1 << 17, 0.01, 1e-4
THRESHOLD = 0.3
LEAST_STEPS = 250
SLICE = 1 << 18


@dataclass
class Network:
    embedding: np.ndarray  # 256 x DEPTH
    filters: np.ndarray  # WIDTH x DEPTH x FILTERS
    bias: np.ndarray
    out: np.ndarray  # 3 FILTERS
    out_bias: np.ndarray
    tables: np.ndarray = field(default_factory=lambda: np.zeros(0))  # WIDTH x 256 x FILTERS

    def fold(self) -> None:
        self.tables = np.einsum("be,kef->kbf", self.embedding, self.filters).astype(np.float32)


def _layout(off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the blocks of non-empty texts, and their numbers of blocks."""
    sizes = np.diff(off)
    blocks = -(-sizes // BLOCK)
    first = np.repeat(off[:-1], blocks)
    within = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    return first + within * BLOCK, blocks


def _convolve(net: Network, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """bytes x filters. A filter that reaches past the end of its text sees nothing there."""
    n = len(buf)
    z = net.tables[0][buf]
    text_end = np.repeat(off[1:], np.diff(off))
    for k in range(1, WIDTH):
        if k >= n:
            break
        more = net.tables[k][buf[k:]]
        over = np.flatnonzero(np.arange(k, n) >= text_end[: n - k])
        more[over] = 0
        z[: n - k] += more
    z += net.bias.astype(np.float32)
    return z


def _chunks(peaks: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Peak of each chunk (a block and the next of its text), start of each text's chunks, chunks a text.

    A text of one block has one chunk.
    """
    last = np.cumsum(blocks) - 1
    following = np.minimum(np.arange(len(peaks)) + 1, len(peaks) - 1)
    following[last] = last
    chunk = np.maximum(peaks, peaks[following])
    return chunk, following, last - blocks + 1


def _features(net: Network, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, dict]:
    """texts x 3 FILTERS of non-empty texts, and what training needs of the way there."""
    z = _convolve(net, buf, off)
    starts, blocks = _layout(off)
    peaks = np.maximum.reduceat(z, starts, axis=0)
    chunk, following, first = _chunks(peaks, blocks)
    active = np.maximum(chunk, 0)
    mean = np.add.reduceat(active, first, axis=0) / blocks[:, None]
    top, low = np.maximum.reduceat(active, first, axis=0), np.minimum.reduceat(active, first, axis=0)
    return np.concatenate((mean, top, low), axis=1), {"z": z, "starts": starts, "blocks": blocks, "peaks": peaks, "chunk": chunk, "following": following, "first": first, "active": active}


def scores(net: Network, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Probability of each text; an empty text has that of the output's bias."""
    sizes = np.diff(off)
    full = np.flatnonzero(sizes > 0)
    logit = np.full(len(sizes), float(net.out_bias[0]))
    if len(full):
        kept = np.concatenate(([0], np.cumsum(sizes[full])))
        features, _ = _features(net, buf, kept)
        logit[full] += features @ net.out
    return 1.0 / (1.0 + np.exp(-np.clip(logit, -30, 30)))


def long_scores(net: Network, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    for low, high, buf, off in slices(column, SLICE):
        yield low, high, scores(net, buf, off)


def _gradients(net: Network, buf: np.ndarray, off: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    features, way = _features(net, buf, off)
    n = len(labels)
    p = 1 / (1 + np.exp(-np.clip(features @ net.out + net.out_bias[0], -30, 30)))
    d_logit = (p - labels) / n
    d_out, d_out_bias = features.T @ d_logit, np.array([d_logit.sum()])
    blocks, active = way["blocks"], way["active"]
    text = np.repeat(np.arange(n), blocks)
    f = FILTERS
    d_active = (d_logit / blocks)[text][:, None] * net.out[:f]
    for part, weights in ((features[:, f : 2 * f], net.out[f : 2 * f]), (features[:, 2 * f :], net.out[2 * f :])):
        hit = active == part[text]
        share = np.add.reduceat(hit, way["first"], axis=0)
        d_active += hit * (d_logit[text][:, None] * weights) / share[text]
    d_chunk = d_active * (way["chunk"] > 0)
    # A chunk's peak is its own block's or the next one's.
    own = way["chunk"] == way["peaks"]
    d_peak = d_chunk * own
    np.add.at(d_peak, way["following"], d_chunk * ~own)
    # Of each block and filter the byte with the peak.
    z, starts = way["z"], way["starts"]
    lengths = np.diff(np.concatenate((starts, [len(buf)])))
    at = np.where(z == np.repeat(way["peaks"], lengths, axis=0), np.arange(len(buf))[:, None], -1)
    at = np.maximum.reduceat(at, starts, axis=0)
    end = off[1:][text][:, None]
    d_tables = np.zeros_like(net.tables, dtype=np.float64)
    filters = np.broadcast_to(np.arange(f), at.shape)
    for k in range(WIDTH):
        ok = (at + k < end) & (d_peak != 0)
        byte = buf[np.minimum(at + k, len(buf) - 1)]
        index = byte[ok].astype(np.int64) * f + filters[ok]
        d_tables[k] = np.bincount(index, weights=d_peak[ok], minlength=256 * f).reshape(256, f)
    return [np.einsum("kbf,kef->be", d_tables, net.filters), np.einsum("be,kbf->kef", net.embedding, d_tables), d_peak.sum(axis=0), d_out, d_out_bias]


def train(texts: list[str], labels: list[int], weights: tuple[float, float] | None = None, epochs: int = EPOCHS) -> Network:
    """Learns from texts and labels (1: good). Texts are taken whole, in batches of about BATCH_BYTES.

    Few texts are cut into smaller batches and read more often, so that the number of steps is LEAST_STEPS or more.
    """
    draw = np.random.Generator(np.random.PCG64(11))
    net = Network(draw.normal(0, 0.5, (256, DEPTH)), draw.normal(0, 0.3, (WIDTH, DEPTH, FILTERS)), np.zeros(FILTERS), np.zeros(3 * FILTERS), np.zeros(1))
    net.fold()
    rows = [(t.encode(), y) for t, y in zip(texts, labels, strict=True) if t]
    if not rows:
        return net
    share = min(max(sum(y for _, y in rows) / len(rows), 0.01), 0.99)
    net.out_bias[:] = np.log(share / (1 - share))
    params = [net.embedding, net.filters, net.bias, net.out, net.out_bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    total = sum(len(t) for t, _ in rows)
    batch_bytes = min(BATCH_BYTES, max(4096, total // 16))
    epochs = max(epochs, -(-LEAST_STEPS * batch_bytes // max(total, batch_bytes)))
    for epoch in range(epochs):
        order = draw.permutation(len(rows))
        rate = RATE * (1 - epoch / epochs) + RATE / 10
        batch, size = [], 0
        for i, k in enumerate(order):
            batch.append(k)
            size += len(rows[k][0])
            if size < batch_bytes and len(batch) < 64 and i < len(order) - 1:
                continue
            buf = np.frombuffer(b"".join(rows[j][0] for j in batch), np.uint8)
            off = np.concatenate(([0], np.cumsum([len(rows[j][0]) for j in batch])))
            grads = _gradients(net, buf, off, np.array([rows[j][1] for j in batch], float))
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                g = g + DECAY * p
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            net.fold()
            batch, size = [], 0
    net.out = net.out.astype(np.float64)
    return net


def fit_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Network:
    """Learns from at most SAMPLE_PER_LABEL labelled texts of each label outside the held-out fold, and SAMPLE_BYTES of each, but for the last text.

    The sample is balanced by a hash; the output's bias is then set back to the labels' true share. A doc_id gives one text, that of the lowest
    hash, however many it has or however often they repeat; a doc_id with two labels has the smaller.
    """
    known = labels.where(F.col("quality").isin(0, 1) & (fold(F.col("doc_id"), 5) != 0)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    # At most 2 * SAMPLE_PER_LABEL ids, whatever the size of the tables.
    chosen = lowest(known.withColumn("_draw", F.xxhash64("doc_id", F.lit(5))), "quality", "_draw", SAMPLE_PER_LABEL)
    hashed = docs.where(F.col("text").isNotNull()).select("doc_id", "text", F.struct(F.xxhash64("text").alias("hash"), F.octet_length("text").alias("size")).alias("_text"))
    # A text an id: only its hash and size go through the first pass, so very long texts that are not taken stay where they are.
    texts = hashed.select("doc_id", "_text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality", "_draw").agg(F.min("_text").alias("_text"))
    sized = texts.select("doc_id", "quality", "_draw", "_text", F.col("_text.size").alias("_size"))
    taken = within_bytes(sized, "quality", "_draw", "_size", SAMPLE_BYTES).select("doc_id", "quality", "_text")
    found = hashed.join(F.broadcast(taken), ["doc_id", "_text"]).groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = sorted((r["doc_id"], r["text"], r["quality"]) for r in found.collect())
    net = train([t for _, t, _ in rows], [y for _, _, y in rows])
    good = sum(y for _, _, y in rows)
    if counts.get(0) and counts.get(1) and 0 < good < len(rows):
        net.out_bias = net.out_bias + np.log(counts[1] / counts[0]) - np.log(good / (len(rows) - good))
    return net


def score_quality(docs: DataFrame, net: Network, keep: list[str] | None = None) -> DataFrame:
    """The kept columns of docs (all, if none are named) with score and predicted, which replace columns of these names.

    A null or empty text has the score of the bias; whole texts are read, in chunks, so very long ones need no more memory. Rows are scored apart, so repeated rows have equal scores, and an
    empty table gives an empty result. Only the texts go to Python, and only scores come back.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            parts = [p for _, _, p in long_scores(shared.value, column)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    rows = docs.select(*(F.col(f"`{c}`") for c in keep), scored(F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op1_byte_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of all documents. Nulls, empty texts and repeated rows as in score_quality()."""
    docs = documents(spark, sf_dir)
    net = fit_quality(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    return score_quality(rows, net, ["doc_id", "held_out"])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents that the classifier accepts, with all their columns, whatever these are called.

    Null and empty texts have no chunk to judge: all of them get the score of the bias, which follows the share of good labels, and so stay
    or go together. Repeated rows stay or go together too; an empty table stays empty. Equal scores are no ties, as each is held against the
    threshold alone.
    """
    net = fit_quality(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), "text")
    return score_quality(rows, net, ["doc"]).where("predicted = 1").select("doc.*")
