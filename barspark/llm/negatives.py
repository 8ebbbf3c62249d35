"""Hard negatives by dual-tree search: exact best inner products within bands, without scoring all pairs.

Candidates are routed through a binary tree of half-spaces to cells; queries are gathered in leaves of the same tree. A ball
around each cell and each inner node gives, with the ball of a group of queries, an interval that holds all their inner products, so
one comparison prunes a whole group of queries against a whole subtree. Pairs of leaves that remain are searched in tasks
of bounded size, again by two trees, and leaf pairs are scored exactly.

The tree's half-spaces are fitted on a bounded sample (SAMPLE_ROWS); every row is routed and counted in the balls, so the sample bears on speed only.
A cell of any size is cut into blocks by row number, and the query leaves that reach a block come in chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barspark.llm.storage import attached, discard, saved

#: Rows that the tree is fitted on, at most, and how many cells it has, at most: bounds of what the driver holds and of what is broadcast.
SAMPLE_ROWS = 16_384
MOST_CELLS = 2_048
#: Bytes of vectors that the sample, the tree's centers and a block may have: wide vectors make them fewer.
SAMPLE_BYTES, TREE_BYTES, BLOCK_BYTES = 32 << 20, 4 << 20, 8 << 20
#: Rows of a block of candidates, queries of a leaf, and leaves that meet a block in one task.
BLOCK_ROWS = 2_048
LEAF_QUERIES = 64
CHUNK_LEAVES = 32
#: Rows of a leaf of the trees inside a task.
SMALL_LEAF = 64
#: Cells that a query leaf scores first, to know how good a result must be.
HOME_CELLS = 2
#: Inner products are exact below 2**53; the bounds of an interval leave room for rounding.
SLACK = 1e-9
#: Scores outside of this are cut to it; a long holds it.
FAR = float(1 << 60)
K = 5


@dataclass(frozen=True)
class Tree:
    """A binary heap of half-spaces: the children of node n are 2n and 2n + 1, the cells are the last level."""

    depth: int
    normals: np.ndarray
    cuts: np.ndarray
    centers: np.ndarray

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cell (heap number) of each row; rows on a cut are dealt by nothing but their value, so equal rows share a cell."""
        node = np.ones(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (np.einsum("ij,ij->i", x, self.normals[node]) > self.cuts[node])
        return node


def fit_tree(sample: np.ndarray, rows: int, width: int) -> Tree:
    """Cuts at the median along the widest direction of each node, until cells have about a block of all rows."""
    most = min(MOST_CELLS, max(1, TREE_BYTES // (8 * width)))
    depth = int(np.ceil(np.log2(min(most, max(1, rows / block_rows(width))))))
    normals, cuts, centers = np.zeros((1 << depth, width)), np.zeros(1 << depth), np.zeros((2 << depth, width))
    inside = {1: sample}
    for n in range(1, 2 << depth):
        x = inside.pop(n)
        centers[n] = x.mean(0) if len(x) else centers[n // 2]
        if n < 1 << depth:
            normals[n] = _direction(x)
            along = x @ normals[n]
            cuts[n] = np.median(along) if len(x) else 0.0
            inside[2 * n], inside[2 * n + 1] = x[along <= cuts[n]], x[along > cuts[n]]
    return Tree(depth, normals, cuts, centers)


def block_rows(width: int) -> int:
    return min(BLOCK_ROWS, max(SMALL_LEAF, BLOCK_BYTES // (8 * width)))


def _direction(x: np.ndarray) -> np.ndarray:
    """A direction in which rows differ much: the largest principal axis, by a few power steps from a fixed start."""
    if len(x) < 2:
        return np.zeros(x.shape[1])
    y = x - x.mean(0)
    v = np.cos(np.arange(1, x.shape[1] + 1) * 1.7) + 0.1
    for _ in range(6):
        v = y.T @ (y @ v)
        size = np.linalg.norm(v)
        if not size > 0 or not np.isfinite(size):
            return np.zeros(x.shape[1])
        v = v / size
    return v


def interval(ca: np.ndarray, ra: np.ndarray, cb: np.ndarray, rb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of a point of ball a with one of ball b, for all pairs of the two arrays of balls."""
    mid = ca @ cb.T
    reach = ra[:, None] * np.linalg.norm(cb, axis=1)[None] + np.linalg.norm(ca, axis=1)[:, None] * rb[None] + ra[:, None] * rb[None]
    room = SLACK * (np.abs(mid) + reach) + 1e-6
    return mid - reach - room, mid + reach + room


@dataclass
class Node:
    rows: np.ndarray
    center: np.ndarray
    radius: float
    labels: frozenset | None
    children: tuple


def small_tree(x: np.ndarray, labels: np.ndarray, rows: np.ndarray | None = None) -> Node:
    """The tree inside a task: halves along the widest direction. labels: those of the rows if at most two, else None."""
    rows = np.arange(len(x)) if rows is None else rows
    mine = x[rows]
    center = mine.mean(0)
    radius = float(np.sqrt(((mine - center) ** 2).sum(1).max()))
    found = np.unique(labels[rows])
    node = Node(rows, center, radius, frozenset(found.tolist()) if len(found) <= 2 else None, ())
    if len(rows) > SMALL_LEAF and radius > 0:
        order = rows[np.argsort(mine @ _direction(mine), kind="stable")]
        half = len(order) // 2
        node.children = (small_tree(x, labels, order[:half]), small_tree(x, labels, order[half:]))
    return node


def _labels_may_meet(a: frozenset | None, b: frozenset | None, same: bool) -> bool:
    if a is None or b is None:
        return True
    return bool(a & b) if same else len(a | b) > 1


def _better(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Positions of the K best: higher scores first, then smaller ids (the null id last), then row numbers."""
    return np.lexsort((rows, ids, -scores))[:K]


@dataclass
class _Search:
    """One chunk of queries against one block of candidates. Band j of query q wants the K best scores from floor[q, j] to ceil[q, j]."""

    queries: np.ndarray
    q_labels: np.ndarray
    q_rows: np.ndarray
    floor: np.ndarray
    ceil: np.ndarray
    cands: np.ndarray
    c_labels: np.ndarray
    c_rows: np.ndarray
    c_ids: np.ndarray
    same: bool

    def run(self) -> list[tuple[int, int, int, int, float]]:
        """(query, band, candidate's row number, its id, score)."""
        bands = self.floor.shape[1]
        self.best = [[(np.empty(0), np.empty(0, np.int64)) for _ in range(bands)] for _ in range(len(self.queries))]
        stack = [(small_tree(self.queries, self.q_labels), small_tree(self.cands, self.c_labels))]
        while stack:
            a, b = stack.pop()
            if not _labels_may_meet(a.labels, b.labels, self.same):
                continue
            low, high = (float(v[0, 0]) for v in interval(a.center[None], np.array([a.radius]), b.center[None], np.array([b.radius])))
            if not (((high >= self.floor[a.rows]) & (low <= self.ceil[a.rows])).any()):
                continue
            if not a.children and not b.children:
                self._score(a.rows, b.rows)
            elif not b.children or (a.children and a.radius > b.radius):
                stack.extend((x, b) for x in a.children)
            else:
                # The child with the greater middle is taken first, as it raises the floors.
                stack.extend((a, x) for x in sorted(b.children, key=lambda x: float(a.center @ x.center)))
        out = []
        for q, per in enumerate(self.best):
            for j, (scores, at) in enumerate(per):
                out += [(int(self.q_rows[q]), j, int(self.c_rows[c]), int(self.c_ids[c]), float(s)) for s, c in zip(scores, at, strict=True)]
        return out

    def _score(self, qs: np.ndarray, cs: np.ndarray) -> None:
        scores = np.clip(self.queries[qs] @ self.cands[cs].T, -FAR, FAR)
        fits = (self.q_labels[qs][:, None] == self.c_labels[cs][None]) == self.same
        fits &= self.q_rows[qs][:, None] != self.c_rows[cs][None]
        for j in range(self.floor.shape[1]):
            hit = fits & (scores >= self.floor[qs, j][:, None]) & (scores <= self.ceil[qs, j][:, None])
            for x in np.flatnonzero(hit.any(1)):
                q, at = qs[x], np.flatnonzero(hit[x])
                s, c = (np.concatenate(p) for p in zip(self.best[q][j], (scores[x, at], cs[at]), strict=True))
                keep = _better(s, self.c_ids[c], self.c_rows[c])
                self.best[q][j] = s[keep], c[keep]
                if len(keep) == K:
                    self.floor[q, j] = max(self.floor[q, j], s[keep[-1]])


#: Ids of rows without one, after all others.
NO_ID = np.iinfo(np.int64).max


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    out = np.zeros((len(column), width))
    for k, v in enumerate(column):
        out[k, : len(v)] = v
    return out


def valid_rows(embeddings: DataFrame) -> DataFrame:
    """row, vec_id, label, vector of embeddings (vec_id, embedding, label) that take part; vector has the components floor(256 * x).

    Rows with a null label, a null vector or any null, infinite or NaN component take no part.
    """
    x = F.col("embedding")
    fine = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * 256).cast("double"))
    rows = embeddings.where(F.col("label").isNotNull() & x.isNotNull() & fine)
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("vector"))


@dataclass(frozen=True)
class Balls:
    """The balls, counts and least and greatest labels of the nodes of a tree over all rows; what tasks get of an index."""

    tree: Tree
    radius: np.ndarray
    count: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, tree: Tree, cells: pd.DataFrame) -> Balls:
        size = 2 << tree.depth
        radius, count = np.full(size, -1.0), np.zeros(size, np.int64)
        low, high = np.full(size, np.iinfo(np.int64).max), np.full(size, np.iinfo(np.int64).min)
        at = cells["cell"].to_numpy(int)
        radius[at], count[at], low[at], high[at] = (cells[c] for c in ("far", "n", "low", "high"))
        for p in range((1 << tree.depth) - 1, 0, -1):
            for c in (2 * p, 2 * p + 1):
                if count[c]:
                    radius[p] = max(radius[p], float(np.linalg.norm(tree.centers[p] - tree.centers[c])) + radius[c])
            both = slice(2 * p, 2 * p + 2)
            count[p], low[p], high[p] = count[both].sum(), low[both].min(), high[both].max()
        return cls(tree, radius, count, low, high)

    def reached(self, x: np.ndarray, labels: np.ndarray, floor: np.ndarray, ceil: np.ndarray, same: bool) -> Iterator[int]:
        """Cells whose interval with some group of the queries meets a band of the group; a cell may come more than once."""
        stack = [(small_tree(x, labels), 1)] if len(x) and self.count[1] else []
        while stack:
            a, n = stack.pop()
            if not self.count[n]:
                continue
            only = frozenset({int(self.low[n])}) if self.low[n] == self.high[n] else None
            if not _labels_may_meet(a.labels, only, same):
                continue
            low, high = (float(v[0, 0]) for v in interval(a.center[None], np.array([a.radius]), self.tree.centers[n : n + 1], self.radius[n : n + 1]))
            if not ((high >= floor[a.rows]) & (low <= ceil[a.rows])).any():
                continue
            cell = n >= 1 << self.tree.depth
            if cell and not a.children:
                yield n
            elif a.children and (cell or a.radius > self.radius[n]):
                stack.extend((c, n) for c in a.children)
            else:
                stack.extend((a, c) for c in (2 * n, 2 * n + 1))


class Index:
    """Candidates in cells and blocks: every valid row with its cell, and the balls of all cells and nodes."""

    def __init__(self, rows: DataFrame) -> None:
        """rows: a saved table of valid_rows()."""
        n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
        self.width = width = max(1, width)
        most = min(SAMPLE_ROWS, max(1, SAMPLE_BYTES // (8 * width)))
        share = min(1.0, most / max(1, n))
        # By a hash of the vector and the row number; the margin keeps the sample below its bound, and limit() holds it there.
        drawn = rows.where(F.pmod(F.xxhash64("vector", "row"), F.lit(1 << 20)) < share * 0.9 * (1 << 20) if share < 1 else F.lit(True))
        tree = fit_tree(_matrix(drawn.select("vector").limit(most).toPandas()["vector"], width), n, width)

        def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                x = _matrix(batch["vector"], width)
                cell = tree.cells(x)
                yield batch.assign(cell=cell, far=np.sqrt(((x - tree.centers[cell]) ** 2).sum(1)))

        self.rows = saved(rows.mapInPandas(routed, "row long, vec_id long, label long, vector array<double>, cell long, far double"), "tree-rows")
        # At most MOST_CELLS rows, whatever the table.
        cells = self.rows.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
        self.balls = Balls.of(tree, cells.toPandas())

    def discard(self) -> None:
        discard(self.rows)

    def _meetings(self, queries: DataFrame, same: bool, home: bool) -> DataFrame:
        """leaf, cell of query leaves and the cells that they must search; home: the most promising HOME_CELLS only."""

        balls, width = self.balls, self.width

        def meet(mine: pd.DataFrame) -> pd.DataFrame:
            x = _matrix(mine["vector"], width)
            cells = sorted(set(balls.reached(x, mine["label"].to_numpy(), np.stack(mine["floor"]), np.stack(mine["ceil"]), same)))
            if home:
                # By the middles of the intervals: the bounds say little where balls are wide.
                cells = sorted(cells, key=lambda c: (-(x @ balls.tree.centers[c]).max(), c))[:HOME_CELLS]
            return pd.DataFrame({"leaf": mine["leaf"].iat[0], "cell": pd.Series(cells, dtype="int64")})

        return queries.groupBy("leaf").applyInPandas(meet, "leaf string, cell long")

    def _met(self, queries: DataFrame, same: bool, home: bool) -> DataFrame:
        """query, band, row, id, score: the K best of each block and band."""
        width, chunked = self.width, saved(self._meetings(queries, same, home), "tree-meetings")
        chunks = saved(chunked.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK_LEAVES).cast("int").alias("chunks")), "tree-chunks")
        blocks = self.rows.groupBy("cell").agg(F.ceil(F.count("*") / block_rows(width)).cast("int").alias("blocks"))
        shape = saved(chunks.join(blocks, "cell"), "tree-shape")
        # By numbers drawn from the row and the leaf, so that no cell, copy or label gathers in one task.
        block, chunk = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("leaf"), F.col("chunks")).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = attached(self.rows, shape, ["cell"]).select("cell", block.alias("block"), every("chunks").alias("chunk"), "row", "vec_id", "label", "vector")
        right = attached(chunked, shape, ["cell"]).select("leaf", "cell", every("blocks").alias("block"), chunk.alias("chunk"))
        right = queries.join(right, "leaf").select("cell", "block", "chunk", "row", "label", "vector", "floor", "ceil")

        def search(cands: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(cands) and len(asked):
                ids = cands["vec_id"].map(lambda v: NO_ID if pd.isna(v) else int(v)).to_numpy(np.int64)
                out = _Search(
                    _matrix(asked["vector"], width), asked["label"].to_numpy(), asked["row"].to_numpy(), np.stack(asked["floor"]).astype(float), np.stack(asked["ceil"]).astype(float),
                    _matrix(cands["vector"], width), cands["label"].to_numpy(), cands["row"].to_numpy(), ids, same,
                ).run()
            return pd.DataFrame(out, columns=["query", "band", "row", "id", "score"])

        key = ["cell", "block", "chunk"]
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(search, "query long, band int, row long, id long, score double")

    def search(self, queries: DataFrame, same: bool) -> DataFrame:
        """query, band, rank (from 1), row, id, score: the K best rows of each band of each query.

        queries: row, label, vector, floor and ceil, arrays of the bands' bounds. same: rows of the query's label, without itself, or of others.
        Higher scores come first, then smaller ids, null ids last (id is NO_ID there), then row numbers.
        """
        one = F.xxhash64("row")
        places = saved(queries.join(self.rows.select("row", "cell"), "row"), "tree-queries")
        counts = saved(places.groupBy("cell").agg(F.ceil(F.count("*") / LEAF_QUERIES).cast("int").alias("_leaves")), "tree-leaves")
        leaf = F.concat_ws(":", "cell", F.pmod(one, F.col("_leaves")))
        leaves = saved(attached(places, counts, ["cell"]).select(leaf.alias("leaf"), "row", "label", "vector", "floor", "ceil"), "tree-asked")
        home = saved(_ranked(self._met(leaves, same, True)), "tree-home")
        # The K-th best found so far is a floor; better and equal rows may still come.
        risen = home.where(F.col("rank") == K).groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("band", "score"))).alias("_risen"))
        floor = F.when(F.col("_risen").isNull(), F.col("floor")).otherwise(F.transform("floor", lambda f, j: F.greatest(f, F.element_at("_risen", j.cast("int")))))
        raised = saved(leaves.join(risen.withColumnRenamed("query", "row"), "row", "left").select("leaf", "row", "label", "vector", floor.alias("floor"), "ceil"), "tree-raised")
        out = saved(_ranked(self._met(raised, same, False)), "tree-best")
        for table in (places, leaves, home, raised):
            discard(table)
        return out


def _ranked(found: DataFrame) -> DataFrame:
    """The K best of each query and band: Spark keeps K rows a task before it shuffles."""
    best = Window.partitionBy("query", "band").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= K)


def hard_negatives(embeddings: DataFrame, anchor: Column | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    embeddings has vec_id, embedding (array of numbers) and label. Anchors are valid rows where anchor holds, by default those whose vec_id is divisible by 100.
    An anchor's positives are its K best other rows of the same label by inner product of floor(256 * x); for each, the K best rows of
    other labels with 80 * positive_score <= 100 * negative_score <= 100 * positive_score are returned, ranked from 1.

    Rows with a null label, a null vector or a null or non-finite component take no part. Vectors of unequal length count as if the shorter
    ended in zeros. Rows that repeat, or share a vec_id, are rows of their own: a copy of an anchor is another row, and an anchor that repeats has its
    rows repeated. Ties go by vec_id, null last, then by an unstated but fixed order of the rows. Scores are exact below 2**53 and end at
    2**60. An empty table gives an empty result; other columns are ignored.
    """
    rows = saved(valid_rows(embeddings.select("vec_id", "embedding", "label")), "tree-valid")
    index = Index(rows)
    asked = rows.where(F.col("vec_id") % 100 == 0 if anchor is None else anchor)
    bound = lambda v: F.array(F.lit(v)).cast("array<double>")
    positives = index.search(asked.select("row", "label", "vector", bound(-2 * FAR).alias("floor"), bound(2 * FAR).alias("ceil")), True)
    positives = positives.select(F.col("query").alias("row"), (F.col("rank") - 1).alias("band"), F.col("id").alias("positive"), F.col("score").alias("positive_score"))
    # Up to K bands an anchor, in the order of its positives.
    bands = positives.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("band", "positive_score"))).alias("_b"))
    # 80 * p <= 100 * n for whole n means n >= ceil(4 * p / 5), here in whole numbers.
    floor = F.expr("transform(_b, b -> CAST((4L * CAST(b.positive_score AS LONG) + pmod(-4L * CAST(b.positive_score AS LONG), 5L)) div 5L AS DOUBLE))")
    ceil = F.transform("_b", lambda b: b["positive_score"])
    wanted = asked.join(bands, "row").select("row", "label", "vector", floor.alias("floor"), ceil.alias("ceil"))
    # Queries of one task have as many bands: missing ones want nothing.
    wanted = wanted.select("row", "label", "vector", *(F.concat(c, F.array_repeat(F.lit(v), K - F.size(c))).alias(c) for c, v in (("floor", 2 * FAR), ("ceil", -2 * FAR))))
    negatives = index.search(wanted, False).select(F.col("query").alias("row"), "band", "rank", F.col("id").alias("negative"), F.col("score").alias("negative_score"))
    named = negatives.join(positives, ["row", "band"]).join(asked.select("row", F.col("vec_id").alias("anchor_id")), "row")
    no_null = lambda c: F.when(F.col(c) != int(NO_ID), F.col(c))
    return named.select(
        "anchor_id", no_null("positive").alias("positive_id"), "rank", no_null("negative").alias("negative_id"), F.col("positive_score").cast("long"), F.col("negative_score").cast("long")
    )


def op11_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hard_negatives() of all embeddings, where vec_id divisible by 7 takes the next label. Nulls, ties, repeated rows and empty tables as there."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", "embedding", label.alias("label")))
