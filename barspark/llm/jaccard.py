"""A self-join of documents on the Jaccard similarity of their word shingles, by T-occurrence search.

Two sets of a and b shingles reach the similarity p / 100 if and only if they share T = ceil(p (a + b) / (100 + p))
or more. T-occurrence search finds the sets that occur T times or more on the inverted lists of a query's shingles. DivideSkip
sets the L longest lists aside, heap-merges the short ones, and probes the long ones by binary search for those
sets that occur T - L times or more on the short ones.

To spread the search over tasks, each set is sent where a partner can be:

1. Equal sets become one, named by a 64-bit digest.
2. Shingles have one order: by rising estimated frequency, then by hash. What is counted for it are the shingles that
   several sets of a task have, summed over all tasks in a sketch of fixed size. The estimate steers the cost, not the result.
   The keys of a set are its pairs of neighbours in that order. A shingle that only one of two sets has breaks at most two pairs
   of its own set and one of the other, so two similar sets have all but 2 n (1 - p / 100) of the pairs of either in common,
   and share one of the first 2 n (1 - p / 100) + 1 keys of each, by rising frequency, then by hash. Unlike single shingles, pairs are
   hardly ever shared by chance, and those within a passage that many documents quote come last.
3. Sets that share such a key and are near in size, directly or through others, form a neighbourhood; they are the components of
   the graph of sets and keys, found from one link to a leader for each. A neighbourhood of bounded size goes to one task, each of its sets once.
   Within it sets that are already linked, through whatever others, are not compared again, so a group of near copies costs
   one link each.
4. A neighbourhood over that bound is dealt by key: all its sets with a key meet under the smallest of their
   names, the leader, in blocks of bounded size and near set sizes that all hold the leader. Sets of a cut group that no links
   join to its leader are queries to its other blocks that have sets near in size, so no pair is missed. A task has the queries of one block
   to one other block, so both its sides are bounded; two such sets of different blocks meet in one task only.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Iterator
from math import log2

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.llm.components import components
from barspark.llm.storage import discard, documents, saved
from barspark.llm.textbytes import LOWER, mixed, shingle_sets, slices, span_hashes, word_bounds

SKETCH_BITS, SKETCH_BLOCKS, FILTER_BITS = 20, 16, 23
BLOCK_SHINGLES = 4_000_000


def least_overlap(a: int, b: int, percent: int) -> int:
    return -(-percent * (a + b) // (100 + percent))


def keys_needed(n: int, percent: int) -> int:
    """How many keys of a set of n shingles a similar set must meet; percent is over 50."""
    return 2 * n * (100 - percent) // 100 + 1


def keys_of(shingles: np.ndarray, frequency: np.ndarray, percent: int) -> np.ndarray:
    """The first keys of a sorted set: hashes of neighbours in the order of estimated frequency."""
    seen = frequency[_bucket(shingles, SKETCH_BITS)]
    # shingles are sorted by hash, so a stable sort by frequency orders by both.
    order = np.argsort(seen, kind="stable")
    row, seen = shingles[order], seen[order]
    pairs = mixed(row[:-1] * np.uint64(0x9E6C63D0676A9A99) + row[1:])
    return pairs[np.lexsort((pairs, seen[:-1]))[: keys_needed(len(shingles), percent)]]


def _sets(column: pa.Array, words: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """First row and the sorted distinct shingles of each text of a slice, A-Z as a-z."""
    for low, high, buf, off in slices(column):
        buf = LOWER[buf]
        start, end, text = word_bounds(buf, off)
        joined, at = shingle_sets(span_hashes(buf, start, end), text, high - low, words)
        yield low, [joined[at[k] : at[k + 1]] for k in range(high - low)]


def _name(shingles: np.ndarray) -> int:
    """The name of a set: a signed 64-bit digest."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).view(np.int64))


def _bucket(shingles: np.ndarray, bits: int) -> np.ndarray:
    return (shingles >> np.uint64(64 - bits)).astype(np.int64)


class _Search:
    """Inverted lists of sets that come in order of rising size."""

    def __init__(self, percent: int):
        self.percent, self.sizes, self.members, self.lists = percent, [], [], {}

    def add(self, member: int, size: int, shingles: list[int]) -> None:
        """Indexes a set under its number; shingles may leave out those that no other set has."""
        k = len(self.sizes)
        self.sizes.append(size)
        self.members.append(member)
        for s in shingles:
            self.lists.setdefault(s, []).append(k)

    def query(self, n: int, shingles: list[int], skip: Callable[[int], bool]) -> Iterator[int]:
        """Numbers of indexed sets similar to a query of size n, without those that are to be skipped by the time they are reached."""
        p = self.percent
        low = bisect_left(self.sizes, -(-p * n // 100))  # smaller sets cannot share enough
        high = bisect_left(self.sizes, n * 100 // p + 1)
        if low >= high:
            return
        least = least_overlap(n, self.sizes[low], p)
        lists = sorted(filter(None, (self.lists.get(s) for s in shingles)), key=len)
        if len(lists) < least:
            return
        longest = len(lists[-1])
        n_long = min(least - 1, int(least / (0.01 * log2(longest + 1) + 1)))
        short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        found: list[tuple[int, int]] = []
        last, count = -1, 0
        for k in heapq.merge(*(x[bisect_left(x, low) :] if low else x for x in short)):
            if k == last:
                count += 1
                continue
            if count >= least - n_long:
                found.append((count, last))
            last, count = k, 1
        if count >= least - n_long:
            found.append((count, last))
        for count, k in sorted(found, reverse=True):
            if k >= high or skip(self.members[k]):
                continue
            need = least_overlap(n, self.sizes[k], p)
            for at, x in enumerate(long):
                if count >= need or count + len(long) - at < need:
                    break
                i = bisect_left(x, k)
                count += i < len(x) and x[i] == k
            if count >= need:
                yield self.members[k]


def _shared(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The sets with shingles as small numbers, without those that one set alone has."""
    values, codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1).astype(np.int32)[codes]
    return [part[part >= 0] for part in np.split(number, np.cumsum([len(s) for s in sets])[:-1])]


def linked_in_block(names: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join whatever sets of a block similarity joins, at most one fewer than sets.

    Sets of a largest group are indexed apart from the others. A set that is like one of that group's latest
    members needs no other link to it, so it is a query to the others alone. main and latest hold sets of that group only: when
    another group has over twice its sets, all are indexed anew, which happens at most as often as the sets can be doubled.
    """
    if not names:
        return []
    shared, parent, group = _shared(sets), list(range(len(names))), [1] * len(names)

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    out: list[tuple[int, int]] = []

    def link(a: int, b: int) -> None:
        out.append((names[a], names[b]))
        a, b = root(a), root(b)
        parent[a] = b
        group[b] += group[a]

    main, others = _Search(percent), _Search(percent)
    latest: deque[int] = deque(maxlen=4)
    largest = None
    order = sorted(range(len(names)), key=lambda k: len(sets[k]))

    def index(k: int) -> None:
        if largest is not None and root(k) == root(largest):
            main.add(k, len(sets[k]), shared[k].tolist())
            latest.append(k)
        else:
            others.add(k, len(sets[k]), shared[k].tolist())

    for at, k in enumerate(order):
        n, numbers = len(sets[k]), shared[k]
        near = None
        for other in reversed(latest):
            need = least_overlap(n, len(sets[other]), percent)
            if len(shared[other]) >= need and len(np.intersect1d(numbers, shared[other], assume_unique=True)) >= need:
                near = other
                break
        if near is not None:
            link(k, near)
        shingles = numbers.tolist()
        for search in (others,) if near is not None else (main, others):
            for other in search.query(n, shingles, lambda m, k=k: root(m) == root(k)):
                link(k, other)
        if group[root(k)] > 1 and (largest is None or root(k) != root(largest) and group[root(k)] > 2 * group[root(largest)]):
            largest = k
            main, others = _Search(percent), _Search(percent)
            latest.clear()
            for earlier in order[:at]:
                index(earlier)
        index(k)
    return out


def links_to_block(queries: list[tuple[int, np.ndarray]], block: list[tuple[int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """All links between queries and the sets of a block."""
    search = _Search(percent)
    for k in sorted(range(len(block)), key=lambda k: len(block[k][1])):
        search.add(k, len(block[k][1]), block[k][1].tolist())
    return [(name, block[k][0]) for name, s in queries for k in search.query(len(s), s.tolist(), lambda m, name=name: block[m][0] == name)]


_MEASURED = "doc_id long, copy long, n long, name long, shingle long, seen long"


def _measure(words: int):
    """Rows (doc_id, copy, n, name) of documents, and (shingle, seen) of shingles that several sets of a run of documents have."""
    columns = ["doc_id", "copy", "n", "name", "shingle", "seen"]

    def several(pending: list[np.ndarray]) -> pa.RecordBatch:
        shingles = np.sort(np.concatenate(pending))
        at = np.flatnonzero(np.concatenate(([True], shingles[1:] != shingles[:-1])))
        counts = np.diff(np.concatenate((at, [len(shingles)])))
        often = counts > 1
        blank = pa.nulls(int(often.sum()), pa.int64())
        return pa.RecordBatch.from_arrays([blank, blank, blank, blank, pa.array(shingles[at[often]].view(np.int64)), pa.array(counts[often].astype(np.int64))], columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[np.ndarray] = []
        known: set[int] = set()
        size = 0
        for batch in batches:
            for low, sets in _sets(batch.column("text"), words):
                names = [_name(s) for s in sets]
                for name, s in zip(names, sets, strict=True):
                    if name not in known:
                        known.add(name)
                        pending.append(s)
                        size += len(s)
                n = len(sets)
                blank = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, n), batch.column("copy").slice(low, n), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.int64()), blank, blank], columns)
                if size > 1 << 22:
                    yield several(pending)
                    pending, size = [], 0
                    known.clear()
        if pending:
            yield several(pending)

    return run


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's share of the sketch of shingle counts."""
    sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
    for pdf in batches:
        np.add.at(sketch, _bucket(pdf["shingle"].to_numpy().view(np.uint64), SKETCH_BITS), pdf["seen"].to_numpy().astype(np.uint32))
    parts = [(k, p) for k, p in enumerate(np.split(sketch, SKETCH_BLOCKS)) if p.any()]
    yield pd.DataFrame({"part": [k for k, _ in parts], "counts": [p.tobytes() for _, p in parts]})


def _added(dtype: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sums the arrays of each part within a task, one at a time."""
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            for part, raw in zip(pdf["part"], pdf["counts"], strict=True):
                a = np.frombuffer(raw, dtype)
                total[part] = total[part] + a if part in total else a
        yield pd.DataFrame({"part": list(total), "counts": [a.tobytes() for a in total.values()]})

    return run


def _collected(rows: DataFrame, dtype: str, parts: int, size: int) -> np.ndarray:
    """The sum of all arrays, of parts pieces, on the driver: its size is fixed."""
    rows = rows.select("part", "counts").repartition(parts, "part").mapInPandas(_added(dtype), "part int, counts binary")
    out = np.zeros((parts, size // parts), dtype)
    for r in rows.collect():
        out[r["part"]] += np.frombuffer(r["counts"], dtype)
    return out.reshape(-1)


def _prefix_rows(batches: Iterator[pa.RecordBatch], words: int, percent: int, sketch, marks=None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, names, sizes) of the sets in a batch, each set once as far as the task remembers."""
    known: set[int] = set()
    frequency = sketch.value
    wanted = None if marks is None else np.unpackbits(marks.value).view(bool)
    for batch in batches:
        for _, sets in _sets(batch.column("text"), words):
            tokens, names, sizes = [], [], []
            for s in sets:
                if not len(s) or (name := _name(s)) in known:
                    continue
                known.add(name)
                if len(known) > 200_000:
                    known.clear()
                if wanted is not None and not wanted[_mark_of(np.array([name]))[0]]:
                    continue
                first = keys_of(s, frequency, percent)
                tokens.append(first)
                names.append(np.full(len(first), name, np.int64))
                sizes.append(np.full(len(first), len(s), np.int32))
            if tokens:
                yield np.concatenate(tokens), np.concatenate(names), np.concatenate(sizes)


def _prefixes(words: int, percent: int, sketch, marks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, names, sizes in _prefix_rows(batches, words, percent, sketch, marks):
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(names), pa.array(sizes)], ["token", "name", "n"])

    return run


_NEAR = "token long, name long, least int, most int, leader long"


def _neighbours(words: int, percent: int, sketch):
    """Rows (token, name, least, most, null) of runs of sets with a key in a task, and (null, name, null, null, leader) of their other sets.

    Sets with a key are put in order of size; a set whose size is too far over that of the one before starts a new run, as no set
    of one run is similar to one of the other. So a key that many sets have moves as a row or a few for each task.
    """
    columns = ["token", "name", "least", "most", "leader"]

    def meet(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        tokens, names, sizes = (np.concatenate([p[k] for p in parts]) for k in range(3))
        order = np.lexsort((names, sizes, tokens))
        tokens, names, sizes = tokens[order], names[order], sizes[order].astype(np.int32)
        fresh = np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (100 * sizes[:-1].astype(np.int64) < percent * sizes[1:].astype(np.int64))))
        first = np.flatnonzero(fresh)
        last = np.concatenate((first[1:], [len(tokens)])) - 1
        leader = names[first][np.cumsum(fresh) - 1]
        links = np.unique(np.stack((names, leader), axis=1)[(~fresh) & (names != leader)], axis=0)
        for k in range(0, len(first), 100_000):
            a, b = first[k : k + 100_000], last[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(tokens[a].view(np.int64)), pa.array(names[a]), pa.array(sizes[a]), pa.array(sizes[b]), pa.nulls(len(a), pa.int64())], columns)
        n = len(links)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(links[:, 0].copy()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.array(links[:, 1].copy())], columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for rows in _prefix_rows(batches, words, percent, sketch):
            parts.append(rows)
            size += len(rows[0])
            if size > 1 << 21:
                yield from meet(parts)
                parts, size = [], 0
        if parts:
            yield from meet(parts)

    return run


def _runs_joined(runs: Column, percent: int) -> Column:
    """Links (u, v) between the runs of a key whose sizes are near enough, in order of their least size."""
    start = F.struct(F.lit(-1).alias("most"), F.lit(0).cast("long").alias("name"), F.array().cast("array<struct<u:bigint,v:bigint>>").alias("links"))

    def step(s: Column, x: Column) -> Column:
        link = F.array(F.struct(s["name"].alias("u"), x["name"].alias("v")))
        joined = F.struct(F.greatest(s["most"], x["most"]).alias("most"), s["name"].alias("name"), F.concat(s["links"], link).alias("links"))
        apart = F.struct(x["most"].alias("most"), x["name"].alias("name"), s["links"].alias("links"))
        return F.when(s["most"].cast("long") * 100 >= x["least"].cast("long") * percent, joined).otherwise(apart)

    return F.aggregate(F.array_sort(runs), start, step, lambda s: s["links"])


def _mark_of(names: np.ndarray) -> np.ndarray:
    return _bucket(mixed(names.view(np.uint64)), FILTER_BITS)


def _marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen = np.zeros(1 << FILTER_BITS, bool)
    for pdf in batches:
        seen[_mark_of(pdf["name"].to_numpy())] = True
    parts = np.split(np.packbits(seen), SKETCH_BLOCKS)
    yield pd.DataFrame({"part": range(SKETCH_BLOCKS), "counts": [p.tobytes() for p in parts]})


def _ored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[int, np.ndarray] = {}
    for pdf in batches:
        for part, raw in zip(pdf["part"], pdf["counts"], strict=True):
            a = np.frombuffer(raw, np.uint8)
            total[part] = total[part] | a if part in total else a
    yield pd.DataFrame({"part": list(total), "counts": [a.tobytes() for a in total.values()]})


def _wanted_sets(words: int, marks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        wanted = np.unpackbits(marks.value).view(bool)
        for batch in batches:
            for _, sets in _sets(batch.column("text"), words):
                names = np.array([_name(s) for s in sets], np.int64)
                keep = np.flatnonzero(wanted[_mark_of(names)])
                keep = [k for k in keep.tolist() if len(sets[k]) and names[k] not in known]
                known.update(names[keep].tolist())
                if len(known) > 200_000:
                    known.clear()
                if keep:
                    yield pa.RecordBatch.from_arrays([pa.array(names[keep]), pa.array([sets[k].tobytes() for k in keep], pa.binary())], ["name", "shingles"])

    return run


def _unpack(pdf: pd.DataFrame) -> list[tuple[int, np.ndarray]]:
    pdf = pdf.drop_duplicates("name")
    return [(int(n), np.frombuffer(s, np.uint64)) for n, s in zip(pdf["name"], pdf["shingles"], strict=True)]


def _edges(rows: list[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame({"u": [a for a, _ in rows], "v": [b for _, b in rows]}, dtype="int64")


def _dealt(routes: DataFrame, percent: int, block_shingles: int) -> DataFrame:
    """routes (leader, name, n) with cut, whether a leader's sets are over a block, and block, where each set is.

    The sets of a cut group are dealt by classes of size, then by hash, which keeps those of different size in different blocks.
    """
    size = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent))).cast("int")
    routes = routes.withColumn("size", size)
    sums = routes.groupBy("leader", "size").agg(F.sum("n").alias("_n"))
    whole = sums.groupBy("leader").agg((F.sum("_n") > block_shingles).alias("cut"))
    sums = sums.join(whole, "leader").select("leader", "size", "cut", F.ceil(F.col("_n") / block_shingles).alias("_parts"))
    part = F.pmod(F.xxhash64("name", F.lit(3)), F.col("_parts"))
    # A class has fewer than 2 ** 32 blocks.
    block = F.when(F.col("cut"), F.shiftleft(F.col("size").cast("long"), 32) + part).otherwise(F.lit(0).cast("long"))
    return routes.join(sums, ["leader", "size"]).select("leader", "name", "n", "cut", block.alias("block"))


def _filter_of(names: DataFrame):
    """A broadcast filter of fixed size that lets through the given names, and some others by chance; None if there are none."""
    marks = saved(names.select("name").mapInPandas(_marks, "part int, counts binary"), "jaccard-marks")
    filled = np.zeros((SKETCH_BLOCKS, (1 << FILTER_BITS) // 8 // SKETCH_BLOCKS), np.uint8)
    for r in marks.repartition(SKETCH_BLOCKS, "part").mapInPandas(_ored, "part int, counts binary").collect():
        filled[r["part"]] |= np.frombuffer(r["counts"], np.uint8)
    return names.sparkSession.sparkContext.broadcast(filled.reshape(-1)) if filled.any() else None


def _copy() -> Column:
    """Tells apart the texts of rows that share a doc_id."""
    return F.xxhash64("text")


def similar_sets(docs: DataFrame, words: int, percent: int, block_shingles: int = BLOCK_SHINGLES) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, copy, n, name) of all documents, copy a hash of the text, and (u, v) links of names whose components are those of all links; None: no link."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    measured = saved(docs.withColumn("copy", _copy()).mapInArrow(_measure(words), _MEASURED), "jaccard-sets")
    members = measured.where("name is not null").select("doc_id", "copy", "n", "name")
    # Dealt by the sketch's parts, so that a task fills one part or a few.
    often = measured.where("shingle is not null").select("shingle", "seen")
    often = often.withColumn("_part", F.shiftrightunsigned("shingle", 64 - SKETCH_BLOCKS.bit_length() + 1)).repartition(SKETCH_BLOCKS, "_part")
    shares = saved(often.select("shingle", "seen").mapInPandas(_summed, "part int, counts binary"), "jaccard-sketch")
    sketch = spark.sparkContext.broadcast(_collected(shares, "uint32", SKETCH_BLOCKS, 1 << SKETCH_BITS))
    near = saved(docs.mapInArrow(_neighbours(words, percent, sketch), _NEAR), "jaccard-near")
    met = near.where("token is not null").groupBy("token").agg(F.collect_set(F.struct("least", "most", "name")).alias("runs")).where(F.size("runs") > 1)
    joined = met.select(F.explode(_runs_joined(F.col("runs"), percent)).alias("e")).select("e.u", "e.v").where("u <> v")
    links = joined.union(near.where("leader is not null").select(F.col("leader").alias("u"), F.col("name").alias("v"))).distinct()
    links = saved(links, "jaccard-met")
    discard(near)
    hoods = saved(components(links), "jaccard-hoods")
    discard(links)
    hoods = hoods.select(F.col("vertex").alias("name"), F.col("root").alias("hood"))
    active = _filter_of(hoods)
    if active is None:
        return members, None
    # What the filter lets through by chance is in no neighbourhood. Copies of a set from several tasks are dropped later.
    sizes = members.where("n > 0").groupBy("name").agg(F.max("n").alias("n")).join(hoods, "name").groupBy("hood").agg((F.sum("n") > block_shingles).alias("large"))
    placed = saved(hoods.join(sizes, "hood"), "jaccard-placed")
    sets = saved(docs.mapInArrow(_wanted_sets(words, active), "name long, shingles binary").join(placed, "name"), "jaccard-found")

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = _unpack(pdf)
        return _edges(linked_in_block([n for n, _ in rows], [s for _, s in rows], percent))

    edges = saved(sets.where("not large").groupBy("hood").applyInPandas(within, "u long, v long"), "jaccard-links")
    large = _filter_of(sets.where("large"))
    if large is None:
        discard(sets)
        return members, edges
    sets = sets.where("large").select("name", "shingles")
    # Dealt by key, as the neighbourhood is too large for one task.
    prefixes = docs.mapInArrow(_prefixes(words, percent, sketch, large), "token long, name long, n int")
    prefixes = saved(prefixes.join(sets.select("name").distinct(), "name", "left_semi"), "jaccard-prefixes")
    shared = prefixes.groupBy("token").agg(F.min("name").alias("leader"), F.max("name").alias("_last")).where("leader < _last")
    routes = prefixes.join(shared.select("token", "leader"), "token").groupBy("leader", "name").agg(F.max("n").alias("n"))
    routes = saved(routes, "jaccard-routes")
    placed = saved(_dealt(routes, percent, block_shingles), "jaccard-dealt")
    discard(routes)
    others = placed.where("name <> leader")
    leaders = others.select("leader", "block").distinct().select("leader", "block", F.col("leader").alias("name"))
    located = others.select("leader", "block", "name").union(leaders).join(sets, "name")
    edges = saved(edges.union(located.groupBy("leader", "block").applyInPandas(within, "u long, v long")), "jaccard-links")
    cut = others.where("cut").select("leader", "block", "name", "n")
    if cut.isEmpty():
        return members, edges
    roots = saved(components(edges), "jaccard-roots")
    root = lambda side: roots.select(F.col("vertex").alias(side), F.col("root").alias(f"_{side}_root"))
    cut = cut.join(root("name"), "name", "left").join(root("leader"), "leader", "left")
    apart = F.coalesce("_name_root", "name") != F.coalesce("_leader_root", "leader")
    cut = saved(cut.select("leader", "block", "name", "n", apart.alias("apart")), "jaccard-cut")
    spans = cut.groupBy("leader", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    asked = cut.where("apart").select("leader", "name", "n", F.col("block").alias("own")).join(spans, "leader")
    # In whole numbers, as T-occurrence search has it.
    near_size = (F.col("least") * percent <= F.col("n") * 100) & (F.col("n") * percent <= F.col("most") * 100)
    asked = asked.where((F.col("block") != F.col("own")) & near_size)
    asked = saved(asked.select("leader", "own", "block", "name", F.lit(True).alias("asks")), "jaccard-asked")
    if asked.isEmpty():
        return members, edges
    # Of two blocks that ask each other, the second one's queries meet those sets only that do not ask themselves.
    there = asked.select("leader", "own", "block").distinct().join(cut, ["leader", "block"]).where("own < block or not apart")
    both = asked.unionByName(there.select("leader", "own", "block", "name", F.lit(False).alias("asks"))).join(sets, "name")

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        return _edges(links_to_block(_unpack(pdf[pdf["asks"]]), _unpack(pdf[~pdf["asks"]]), percent))

    more = both.groupBy("leader", "own", "block").applyInPandas(across, "u long, v long")
    return members, saved(edges.union(more), "jaccard-links")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) of every row of docs.

    A document's set are its distinct shingles of that many words; with fewer words, the whole sequence is one; without words
    (or a null text) it is empty and linked with nothing. Two documents link at percent / 100 or more. Rows with equal
    texts are one class; a null doc_id counts as the largest. Other columns are ignored; an empty table gives an empty result.
    """
    members, worded = _classes(docs, words, percent)
    joined = members.join(worded.select("name", "least"), (members["name"] == worded["name"]) & (members["n"] > 0), "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def _classes(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, copy, n, name) of all documents, and (name, root, least) of sets with words: its component and that's smallest doc_id."""
    members, edges = similar_sets(docs, words, percent)
    worded = members.where("n > 0").groupBy("name").agg(F.min("doc_id").alias("least")).withColumn("root", F.col("name"))
    if edges is not None and not edges.isEmpty():
        roots = components(edges).select(F.col("vertex").alias("name"), F.col("root").alias("_root"))
        worded = worded.join(roots, "name", "left").select("name", "least", F.coalesce("_root", "name").alias("root"))
        per_root = worded.groupBy("root").agg(F.min("least").alias("component"))
        worded = worded.join(per_root, "root").select("name", "root", F.col("component").alias("least"))
    return members, worded.select("name", "root", "least")


def op9_t_occurrence_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=4, percent=85)


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents without near copies: of each group one row with the smallest doc_id stays, and all rows without words.

    Rows that repeat a doc_id, null too, are documents of their own. A null doc_id counts as the largest; of the texts with a group's
    smallest doc_id the one with the smallest hash stays, and one of its rows. Columns stay as they are, whatever their names; an empty
    table stays empty.
    """
    members, worded = _classes(docs, 5, 80)
    # Nulls are the least of a struct's fields, so whether there is one goes first.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copy", "_rows")).alias("first")
    texts = members.where("n > 0").groupBy("name", "doc_id", "copy").agg(F.count("*").alias("_rows"))
    kept = texts.join(worded.select("name", "root"), "name").groupBy("root").agg(first)
    kept = kept.select("first.doc_id", "first.copy", (F.col("first._rows") > 1).alias("_several"))
    wordless = members.where("n = 0").select("doc_id", "copy", F.lit(False).alias("_several")).distinct()
    kept = saved(kept.union(wordless), "jaccard-kept").alias("k")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    keyed = docs.select(whole.alias("doc"), F.col("doc_id").cast("long").alias("id"), _copy().alias("copy")).alias("d")
    rows = keyed.join(kept, F.col("d.id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.copy") == F.col("k.copy"))).select("d.*", "_several")
    # Rows that share id and text are the exception; of those the first by their values as JSON stays.
    one = rows.where("_several").groupBy("id", "copy").agg(F.min_by("doc", F.to_json("doc")).alias("doc")).select("doc")
    return one.union(rows.where("not _several").select("doc")).select("doc.*")
