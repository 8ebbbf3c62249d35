"""Language-model scores from an Elias-Fano n-gram trie.

The trie has a level of words and a level of pairs of words. A word is its 64-bit hash; the sorted hashes are an
Elias-Fano sequence, and the rank of a word's hash is its number. The successors of a word stand together in the
level of pairs, in order of number, behind a monotone pointer. Pointers are an Elias-Fano sequence; so
are the successors, made monotone by adding the last value of the context before. A pair is found by a successor search inside the
range of its context, relative to that value.

Probabilities are smoothed by absolute discounting, interpolated with the lower order, and kept as 16-bit
steps of 1/STEPS in -log10. No pair is dropped; where min_pair is set higher, pairs seen fewer times are pruned and their mass goes to the back-off weight of their
context, so that the probabilities after each context, the unknown word included, sum to 1.

The trie is cut into shards by the first word's hash. Shards are built apart, each by the task that has its counts, and written to the
shared folder; tasks map the files from there, so no driver and no executor keeps a copy, and what a batch of texts does not ask for
is not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.llm.eliasfano import EliasFano, packed, unpacked
from barspark.llm.sampling import fold
from barspark.llm.storage import discard, documents, new_path, put, remove, saved, view
from barspark.llm.textbytes import LOWER, mixed, slices, span_hashes, word_bounds

#: The hash that stands for the end of a text, which is also what stands before its first word.
END = np.uint64(0x5851F42D4C957F2D)
MIN_PAIR = 1
STEPS = 3500  # quantisation: -log10 from 0 to 18.7 in 65,536 steps
PENDING = 1 << 21
WORDS_PER_SHARD = 50_000


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z as a-z, each text closed by END; and the text numbers."""
    buf = LOWER[buf]
    start, end, text = word_bounds(buf, off)
    words = span_hashes(buf, start, end)
    n_texts = len(off) - 1
    place = np.arange(len(words)) + text
    out = np.full(len(words) + n_texts, END, np.uint64)
    out[place] = words
    owner = np.repeat(np.arange(n_texts), np.bincount(text, minlength=n_texts) + 1)
    return out, owner


def _contexts(words: np.ndarray, owner: np.ndarray, end_id: int) -> np.ndarray:
    """The word before each; before a text's first word stands END."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[np.concatenate(([True], owner[1:] != owner[:-1]))] = end_id
    return before


class _Counter:
    """Counts of 64-bit keys in bounded memory: what is pending is summed, and given out when it grows."""

    def __init__(self):
        self.keys, self.counts, self.size = [], [], 0

    def add(self, keys: np.ndarray) -> None:
        keys = np.sort(keys)
        at = np.flatnonzero(np.concatenate((keys[:1] == keys[:1], keys[1:] != keys[:-1])))
        self.keys.append(keys[at])
        self.counts.append(np.diff(np.concatenate((at, [len(keys)]))))
        self.size += len(at)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        at = np.flatnonzero(np.concatenate((keys[:1] == keys[:1], keys[1:] != keys[:-1])))
        self.__init__()
        return keys[at], np.add.reduceat(counts, at) if len(at) else counts

    def batches(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        if self.size >= PENDING or last:
            keys, counts = self.take()
            for k in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 100_000].view(np.int64)), pa.array(counts[k : k + 100_000].astype(np.int64))], ["key", "n"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter = _Counter()
    for batch in batches:
        for _, _, buf, off in slices(batch.column("text")):
            counter.add(tokens(buf, off)[0])
            yield from counter.batches()
    yield from counter.batches(last=True)


def _quantised(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(np.maximum(p, 1e-18)) * STEPS), 0, 65535).astype(np.uint16)


class _Shards(dict):
    """What shards of a level hold, each read when it is first asked for."""

    def __init__(self, sources: dict[int, Callable[[], np.ndarray]], parts: Callable[[dict, list[np.ndarray]], tuple]):
        super().__init__()
        self.sources, self.parts = sources, parts

    def __contains__(self, shard: object) -> bool:
        return shard in self.sources

    def __missing__(self, shard: int) -> tuple:
        self[shard] = self.parts(*unpacked(self.sources[shard]()))
        return self[shard]


def _word_parts(head: dict, arrays: list[np.ndarray]) -> tuple:
    return EliasFano.from_parts(head["words"], arrays[:4]), arrays[4], arrays[5]


def _pair_parts(head: dict, arrays: list[np.ndarray]) -> tuple:
    return EliasFano.from_parts(head["pointers"], arrays[:4]), EliasFano.from_parts(head["successors"], arrays[4:8]), arrays[8], arrays[9]


class Trie:
    """Shards of both levels, opened on first use, and the numbers that go with them."""

    def __init__(self, about: dict, words: dict[int, Callable[[], np.ndarray]], pairs: dict[int, Callable[[], np.ndarray]]):
        """about: shard_bits, first (number of each shard's first word), total, vocabulary, discounts, end. words, pairs: how a shard's bytes are read."""
        self.about = about
        self.first = np.array(about["first"], np.int64)
        self.words, self.pairs = _Shards(words, _word_parts), _Shards(pairs, _pair_parts)
        # Recent answers by hash: numbers of words, and log-probabilities of pairs.
        self.recent_key, self.recent_id = np.zeros(1 << 19, np.uint64), np.full(1 << 19, -1, np.int64)
        self.recent_count = np.zeros(1 << 19, np.int64)
        self.pair_key, self.pair_value = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20)
        v, d, total = about["vocabulary"], about["discounts"][0], max(about["total"], 1)
        self.floor = d * v / total / (v + 1)

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and count of each word, -1 and 0 if unknown."""
        slot = (hashes >> np.uint64(17)).astype(np.int64) & (len(self.recent_key) - 1)
        todo = np.flatnonzero(self.recent_key[slot] != hashes)
        out, counts = self.recent_id[slot], self.recent_count[slot]
        if len(todo):
            asked = np.unique(hashes[todo])
            found, seen = np.full(len(asked), -1, np.int64), np.zeros(len(asked), np.int64)
            shard = (asked >> np.uint64(64 - self.about["shard_bits"])).astype(np.int64)
            for s, a, b in _runs(shard):
                if s in self.words:
                    words, codes, values = self.words[s]
                    at = words.find(asked[a:b])
                    hit = np.flatnonzero(at >= 0)
                    found[a + hit] = at[hit] + self.first[s]
                    seen[a + hit] = values[codes[at[hit]]]
            back = np.searchsorted(asked, hashes[todo])
            out[todo], counts[todo] = found[back], seen[back]
            at = slot[todo]
            self.recent_key[at], self.recent_id[at], self.recent_count[at] = hashes[todo], out[todo], counts[todo]
        return out, counts

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        """Count of each word by number, 0 for -1."""
        out = np.zeros(len(numbers), np.int64)
        order = np.argsort(numbers, kind="stable")
        ordered = numbers[order]
        shard = np.searchsorted(self.first, ordered, "right") - 1
        for s, a, b in _runs(shard):
            if s >= 0 and s in self.words:
                _, codes, values = self.words[s]
                out[order[a:b]] = values[codes[ordered[a:b] - self.first[s]]]
        out[numbers < 0] = 0
        return out

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.maximum(counts - self.about["discounts"][0], 0) / max(self.about["total"], 1) + self.floor

    def log_probabilities(self, before: np.ndarray, words: np.ndarray, counts: np.ndarray, before_counts: np.ndarray) -> np.ndarray:
        """log10 p(word | before); before and words are known numbers or -1, counts are theirs."""
        out = np.log10(self.unigram(counts))
        # A word as rare as this is in no pair that was kept; as a context its back-off weight is 1.
        least = self.about["min_pair"]
        known = np.flatnonzero(before_counts >= least)
        key = before[known] * (self.about["vocabulary"] + 1) + words[known] + 1
        slot = (mixed(key.view(np.uint64)) >> np.uint64(44)).astype(np.int64)
        recent = self.pair_key[slot] == key
        out[known[recent]] = self.pair_value[slot[recent]]
        todo, key, slot = known[~recent], key[~recent], slot[~recent]
        order = todo[np.argsort(before[todo], kind="stable")]
        shard = np.searchsorted(self.first, before[order], "right") - 1
        for s, a, b in _runs(shard):
            if s not in self.pairs:
                continue
            rows = order[a:b]
            pointers, successors, probability, backoff = self.pairs[s]
            context = before[rows] - self.first[s]
            out[rows] += backoff[context] / -float(STEPS)
            some = np.flatnonzero((counts[rows] >= least) & (backoff[context] > 0))
            if not len(some):
                continue
            context = context[some]
            fresh = np.concatenate(([True], context[1:] != context[:-1]))
            distinct, back = context[fresh], np.cumsum(fresh) - 1
            start, end = (x.astype(np.int64) for x in pointers.access_pairs(distinct))
            base = np.where(start > 0, successors.access(np.maximum(start - 1, 0)), 0).astype(np.int64)
            at = successors.find(base[back] + words[rows[some]] + 1, start[back], end[back])
            hit = np.flatnonzero(at >= 0)
            out[rows[some[hit]]] = probability[at[hit]] / -float(STEPS)
        self.pair_key[slot], self.pair_value[slot] = key, out[todo]
        return out


def _runs(ordered: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, end) of runs of equal values."""
    if not len(ordered):
        return
    at = np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, [len(ordered)]))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield int(ordered[a]), a, b


def _word_shard(shard: int, keys: np.ndarray, n: np.ndarray) -> bytes:
    """Level 1 of a shard: sorted hashes, and the code of each word's count."""
    order = np.argsort(keys)
    about, arrays = EliasFano.of(keys[order]).parts()
    return packed({"level": 1, "shard": shard, "words": about}, [*arrays, *_coded(n[order])])


def _coded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of values and the value of each code; few values are common."""
    table, codes = np.unique(values, return_inverse=True)
    kind = np.uint8 if len(table) < 256 else np.uint16 if len(table) < 65536 else np.uint32
    return codes.astype(kind), table.astype(np.int64)


def _count_shard(shard: int, first: int, n_contexts: int, vocabulary: int, keys: np.ndarray, n: np.ndarray) -> bytes:
    """Level 2 of a shard before smoothing: pointers, successors and counts."""
    order = np.argsort(keys)
    keys, n = keys[order].astype(np.int64), n[order]
    context, word = keys // vocabulary - first, keys % vocabulary
    pointer = np.concatenate(([0], np.cumsum(np.bincount(context, minlength=n_contexts)))).astype(np.uint64)
    # Relative to the last value of the context before: 1 + number of the word, so that values rise.
    fresh = np.concatenate((context[:1] == context[:1], context[1:] != context[:-1]))
    last = np.flatnonzero(np.concatenate((fresh[1:], fresh[:1])))
    group = np.cumsum(fresh) - 1
    base = np.concatenate(([0], np.cumsum(word[last] + 1)[:-1])) if len(word) else np.zeros(0, np.int64)
    values = (base[group] + word + 1).astype(np.uint64) if len(word) else np.zeros(0, np.uint64)
    about_p, pointers = EliasFano.of(pointer).parts()
    about_s, successors = EliasFano.of(values).parts()
    return packed({"level": 2, "shard": shard, "pointers": about_p, "successors": about_s}, [*pointers, *successors, *_coded(n)])


def _smoothed(trie: Trie, memory: np.ndarray) -> bytes:
    """Level 2 of a shard: for the counts the probabilities of the pairs, and the contexts' back-off weights."""
    head, arrays = unpacked(memory)
    shard, discount = head["shard"], trie.about["discounts"][1]
    first, n_contexts = int(trie.first[shard]), trie.words[shard][0].n
    pointer = EliasFano.from_parts(head["pointers"], arrays[:4]).access(np.arange(n_contexts + 1)).astype(np.int64)
    values = EliasFano.from_parts(head["successors"], arrays[4:8])
    values = values.access(np.arange(pointer[-1])).astype(np.int64) if pointer[-1] else np.zeros(0, np.int64)
    n = arrays[9][arrays[8]]
    context = np.repeat(np.arange(n_contexts), np.diff(pointer))
    start = pointer[:-1][context]
    word = values - np.where(start > 0, values[np.maximum(start - 1, 0)], 0) - 1
    seen = trie.counts(np.arange(first, first + n_contexts))
    kept = np.bincount(context, weights=n - discount, minlength=n_contexts)
    backoff = 1.0 - kept / np.maximum(seen, 1)
    p = (n - discount) / seen[context] + backoff[context] * trie.unigram(trie.counts(word))
    # A context with successors has a step at least, so that a 0 says that it has none.
    weights = np.where(kept > 0, np.maximum(_quantised(backoff), 1), 0).astype(np.uint16)
    return packed(head, [*arrays[:8], _quantised(p), weights])


class Model:
    """A handle of a trie in the shared folder: pickled into tasks, opened there once a worker."""

    def __init__(self, about: dict, where: str):
        self.about, self.where = about, where
        self.words: list[int] = []
        self.pairs: list[int] = []
        self.name = uuid.uuid4().hex

    def file(self, level: str, shard: int) -> str:
        return f"{self.where}/{level}-{shard}"

    def changed(self) -> None:
        """Gives the model a new name, so that workers open it anew."""
        self.name = uuid.uuid4().hex

    def open(self) -> Trie:
        if _OPEN.get("name") != self.name:
            readers = [{s: partial(view, self.file(level, s)) for s in shards} for level, shards in (("words", self.words), ("pairs", self.pairs))]
            _OPEN.clear()
            _OPEN.update(name=self.name, trie=Trie(self.about, *readers))
        return _OPEN["trie"]


_OPEN: dict = {}


def _ones_and_twos(counts: DataFrame) -> tuple[int, int]:
    return tuple(counts.agg(F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first())


def _discount(one: int, two: int) -> float:
    """n1 / (n1 + 2 n2), from the numbers of keys seen once and twice."""
    return one / (one + 2 * two) if one and two else 0.5


def train(texts: DataFrame, min_pair: int = MIN_PAIR) -> Model:
    """Counts all of the texts (column text; null: empty) and builds the trie.

    The counts of a partition are summed in its task before they are shuffled, and those of a pair before they meet the others of their
    shard. What the driver gets are a row a shard and counts of counts.
    """
    spark = texts.sparkSession
    words = saved(texts.select("text").mapInArrow(_count_words, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "lm-words")
    total, vocabulary = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    bits = max(1, (vocabulary // WORDS_PER_SHARD).bit_length())
    about = {"shard_bits": bits, "first": [], "total": total, "vocabulary": vocabulary, "min_pair": min_pair, "discounts": [_discount(*_ones_and_twos(words)), 0.5]}
    model = Model(about, new_path(spark, "lm-trie"))

    def build_words(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(key[0])
        put(model.file("words", shard), _word_shard(shard, pdf["key"].to_numpy().view(np.uint64), pdf["n"].to_numpy()))
        return pd.DataFrame({"shard": [shard], "n": [len(pdf)]})

    # The top bits of a hash are its shard, so that shards follow the order of hashes.
    by_hash = words.withColumn("shard", F.shiftrightunsigned("key", 64 - bits).cast("int"))
    sizes = {r["shard"]: r["n"] for r in by_hash.groupBy("shard").applyInPandas(build_words, "shard int, n long").collect()}
    discard(words)
    first = np.concatenate(([0], np.cumsum([sizes.get(s, 0) for s in range(1 << bits)])))[:-1]
    about["first"], model.words = first.tolist(), sorted(sizes)
    model.changed()
    if not vocabulary:
        return model

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, counter = model.open(), _Counter()
        end_id = int(trie.numbers(np.array([END], np.uint64))[0][0])
        for batch in batches:
            for _, _, buf, off in slices(batch.column("text")):
                hashes, owner = tokens(buf, off)
                numbers, _ = trie.numbers(hashes)
                counter.add((_contexts(numbers, owner, end_id) * vocabulary + numbers).astype(np.uint64))
                yield from map(with_shard, counter.batches())
        yield from map(with_shard, counter.batches(last=True))

    def with_shard(batch: pa.RecordBatch) -> pa.RecordBatch:
        shard = np.searchsorted(first, batch.column("key").to_numpy() // vocabulary, "right") - 1
        return batch.append_column("shard", pa.array(shard.astype(np.int32)))

    def build_counts(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        shard, n = int(key[0]), pdf["n"].to_numpy()
        kept = n >= min_pair
        put(model.file("counts", shard), _count_shard(shard, int(first[shard]), sizes[shard], vocabulary, pdf["key"].to_numpy()[kept], n[kept]))
        return pd.DataFrame({"shard": [shard], "one": [int((n == 1).sum())], "two": [int((n == 2).sum())]})

    counted = texts.select("text").mapInArrow(count_pairs, "key long, n long, shard int").groupBy("shard", "key").agg(F.sum("n").alias("n"))
    built = counted.groupBy("shard").applyInPandas(build_counts, "shard int, one long, two long").collect()
    about["discounts"][1] = _discount(sum(r["one"] for r in built), sum(r["two"] for r in built))
    model.changed()

    def smooth(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in pdf["shard"].tolist():
                put(model.file("pairs", s), _smoothed(model.open(), view(model.file("counts", s))))
            yield pdf

    shards = sorted(r["shard"] for r in built)
    rows = spark.createDataFrame([(s,) for s in shards], "shard int").repartition(min(len(shards), 2_000))
    model.pairs = sorted(r["shard"] for r in rows.mapInPandas(smooth, "shard int").collect())
    for s in shards:
        remove(model.file("counts", s))
    model.changed()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    A null or empty text is the single token END. Unknown words share the probability that a model of its training words
    leaves to them. Rows are independent, so repeated and equal texts have equal scores; an empty table gives an empty result, and a model of no
    texts knows no word. Other columns are ignored.
    """
    total, vocabulary = model.about["total"], model.about["vocabulary"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = model.open()
        end_id, end_count = (int(x[0]) for x in trie.numbers(np.array([END], np.uint64)))
        for batch in batches:
            for low, high, buf, off in slices(batch.column("text")):
                n = high - low
                hashes, owner = tokens(buf, off)
                numbers, counts = trie.numbers(hashes)
                base = np.log10((counts + 0.1) / (total + 0.1 * (vocabulary + 1)))
                own = trie.log_probabilities(_contexts(numbers, owner, end_id), numbers, counts, _contexts(counts, owner, end_count))
                rest = [batch.column(c).slice(low, n) for c in ("doc_id", "held_out")]
                per = [np.bincount(owner, minlength=n), np.bincount(owner, counts > 0, n).astype(np.int64), np.full(n, total), np.bincount(owner, base, n), np.bincount(owner, own, n)]
                yield pa.RecordBatch.from_arrays([*rest, *map(pa.array, per)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), 10) == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op3_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score() of all documents by a model of nine of the ten folds."""
    docs = documents(spark, sf_dir)
    return score(docs, train(docs.where(fold(F.col("doc_id"), 10) != 0)))
