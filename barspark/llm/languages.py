"""Language identification with a string kernel.

The kernel of two texts is the cosine of their sets of byte n-grams of all lengths from 1 to 3 (blended
spectrum, presence only). Its features are the n-grams that some landmark has: both the common n-grams and the norms count those alone,
so the kernel is exactly the cosine in that space. Landmark texts give a Nyström map of the kernel,
and one-versus-rest kernel ridge regression on it has one column of weights a language. Scoring a batch is two
matrix products: n-gram flags by landmarks, and kernel values by languages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.llm.sampling import fold, hash_sample
from barspark.llm.storage import documents
from barspark.llm.textbytes import LOWER, slices

#: The bound of the training sample: about so many texts a language. Of them so many are landmarks, fewer where there are over 64
#: languages, but one at least, so that the kernel matrix of landmarks stays small.
SAMPLE_PER_LANGUAGE, LANDMARKS_PER_LANGUAGE, LANDMARKS = 300, 24, 1536
#: Texts of all languages, about, and bytes of those of one, at most but for the last text.
SAMPLE, SAMPLE_BYTES = 30_000, 16 << 20
RIDGE, SHARPNESS = 1e-3, 8.0
#: Besides whole texts, pieces of so many bytes from the sample are learnt from, as short texts have few n-grams.
PIECES = (24, 80)
ROWS = 256

HAS_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class LanguageModel:
    languages: list[str]
    grams: np.ndarray  # codes of the n-grams in the dictionary
    landmarks: np.ndarray  # grams x landmarks, 0 or 1
    sizes: np.ndarray  # distinct n-grams of each landmark
    weights: np.ndarray  # landmarks x languages


def gram_codes(buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, text numbers) of all n-grams, for n from 1 to 3; the code holds the length. A-Z count as a-z."""
    b = LOWER[buf].astype(np.int32)
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    yield b, text
    if len(b) > 1:
        inside = text[1:] == text[:-1]
        yield (256 + (b[:-1] << 8) + b[1:])[inside], text[:-1][inside]
    if len(b) > 2:
        inside = text[2:] == text[:-2]
        yield (65792 + (b[:-2] << 16) + (b[1:-1] << 8) + b[2:])[inside], text[:-2][inside]


N_CODES = 256 + 65536 + (1 << 24)


def gram_flags(table: np.ndarray, n_grams: int, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """texts x n-grams of the dictionary: which the text has. table maps codes to numbers from 1, others to 0."""
    flags = np.zeros((len(off) - 1, n_grams + 1), np.uint8)
    flat = flags.reshape(-1)
    for codes, text in gram_codes(buf, off):
        flat[text * (n_grams + 1) + table[codes]] = 1
    return flags[:, 1:]


def code_table(grams: np.ndarray) -> np.ndarray:
    table = np.zeros(N_CODES, np.uint16 if len(grams) < 65535 else np.int32)
    table[grams] = np.arange(1, len(grams) + 1)
    return table


def kernel(flags: np.ndarray, model_landmarks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    common = flags.astype(np.float32) @ model_landmarks
    own = np.maximum(flags.sum(axis=1, dtype=np.int64), 1)
    return common / np.sqrt(own[:, None] * np.maximum(sizes, 1)[None, :])


def _kernels(texts: list[str], model: LanguageModel, table: np.ndarray) -> np.ndarray:
    parts = [kernel(gram_flags(table, len(model.grams), buf, off), model.landmarks, model.sizes) for _, _, buf, off in slices(pa.array(texts, pa.string()), max_rows=ROWS)]
    return np.concatenate(parts) if parts else np.zeros((0, len(model.sizes)))


def fit(texts: list[str], languages: list[str]) -> LanguageModel:
    """Fits the model to a sample. Landmarks are the first texts with letters of each language, as many of each."""
    rows = [(t, x) for t, x in zip(texts, languages, strict=True) if t and HAS_LETTER.search(t)]
    names = sorted({x for _, x in rows})
    each = max(1, min(LANDMARKS_PER_LANGUAGE, LANDMARKS // max(1, len(names))))
    of_language: dict[str, list[str]] = {n: [] for n in names}
    for t, x in rows:
        if len(of_language[x]) < each:
            of_language[x].append(t)
    marks = [t for n in names for t in of_language[n]]
    if not marks:
        return LanguageModel([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros(0), np.zeros((0, 0)))
    codes = [np.unique(c) for _, _, buf, off in slices(pa.array(marks), max_rows=ROWS) for c, _ in gram_codes(buf, off)]
    grams = np.unique(np.concatenate(codes)).astype(np.int64)
    table = code_table(grams)
    flags = np.concatenate([gram_flags(table, len(grams), buf, off) for _, _, buf, off in slices(pa.array(marks), max_rows=ROWS)])
    model = LanguageModel(names, grams, flags.T.astype(np.float32).copy(), flags.sum(axis=1, dtype=np.int64), np.zeros(0))
    learn = list(rows)
    for size in PIECES:
        for k, (t, x) in enumerate(rows):
            start = (k * 7919) % max(1, len(t) - size)
            learn.append((t[start : start + size], x))
    k_nm = _kernels([t for t, _ in learn], model, table).astype(np.float64)
    k_mm = _kernels(marks, model, table).astype(np.float64)
    values, vectors = np.linalg.eigh((k_mm + k_mm.T) / 2)
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    phi = k_nm @ root
    # Every language weighs the same, however many texts the sample has of it.
    number = {n: k for k, n in enumerate(names)}
    of = np.array([number[x] for _, x in learn])
    weight = 1.0 / np.bincount(of, minlength=len(names))[of]
    target = np.where(of[:, None] == np.arange(len(names))[None, :], 1.0, 0.0)
    gram = phi.T @ (phi * weight[:, None]) + RIDGE * np.eye(phi.shape[1])
    model.weights = (root @ np.linalg.solve(gram, phi.T @ (target * weight[:, None]))).astype(np.float32)
    return model


def predict(model: LanguageModel, table: np.ndarray, column: pa.Array) -> tuple[list[str], np.ndarray]:
    names, scores = [], []
    for low, high, buf, off in slices(column, max_rows=ROWS):
        texts = column.slice(low, high - low).to_pylist()
        letters = np.array([t is not None and HAS_LETTER.search(t) is not None for t in texts], bool)
        if not model.languages:
            names += ["und"] * len(texts)
            scores.append(np.zeros(len(texts)))
            continue
        raw = kernel(gram_flags(table, len(model.grams), buf, off), model.landmarks, model.sizes) @ model.weights
        sharp = np.exp(SHARPNESS * (raw - raw.max(axis=1, keepdims=True)))
        share = (sharp / sharp.sum(axis=1, keepdims=True)).max(axis=1)
        best = raw.argmax(axis=1)
        names += [model.languages[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
        scores.append(np.where(letters, share, 0.0).astype(np.float64))
    return names, np.concatenate(scores) if scores else np.zeros(0)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score of every text.

    A null text and one without a letter are `und` with score 0. Texts are scored in slices of bounded size,
    whatever their length. Other columns are ignored, repeated rows give repeated results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        table = code_table(known.grams)
        for batch in batches:
            names, scores = predict(known, table, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "text")
    return rows.mapInArrow(scored, "doc_id long, held_out boolean, lang_pred string, score double")


def fit_languages(docs: DataFrame) -> LanguageModel:
    """Fits to at most SAMPLE_PER_LANGUAGE texts for each language that the learning fold has, SAMPLE in all, and SAMPLE_BYTES a language.

    Every language is learnt, however rows repeat.
    """
    known = docs.where((fold(F.col("doc_id"), 3) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sample = hash_sample(known.select("doc_id", "text", "lang"), "lang", SAMPLE_PER_LANGUAGE, SAMPLE, SAMPLE_BYTES)
    rows = sorted((r["lang"], r["doc_id"] if r["doc_id"] is not None else -1, r["text"]) for r in sample.collect())
    # In an order that does not follow doc_id.
    rows = [rows[k] for k in np.random.Generator(np.random.PCG64(3)).permutation(len(rows))]
    return fit([t for _, _, t in rows], [x for x, _, _ in rows])


def op5_kernel_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identify() of all documents, after learning from two of the three folds. Ties go to the first language by name."""
    docs = documents(spark, sf_dir)
    return identify(docs, fit_languages(docs))
