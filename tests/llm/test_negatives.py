"""Dual-tree search against all scores: the SQL of the query, and loops on odd rows, ties and hot copies."""

import numpy as np
import pandas as pd
import pytest

from barspark.llm import negatives as N
from barspark.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_queries import duck, same


def brute(rows, k=5):
    """Rows of the result for [(vec_id, label, vector)]; vec_id of a null counts last."""
    valid = [(i, l, np.floor(256 * np.array(v, float))) for i, l, v in rows if l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    dot = lambda a, b: int(a[: len(b)] @ b[: len(a)])
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    for a, (anchor, label, v) in enumerate(valid):
        if anchor is None or anchor % 100:
            continue
        scores = [(dot(v, w), i, m == label) for b, (i, m, w) in enumerate(valid) if b != a]
        for p, positive, _ in sorted((s for s in scores if s[2]), key=order)[:k]:
            fits = sorted((s for s in scores if not s[2] and 80 * p <= 100 * s[0] <= 100 * p), key=order)[:k]
            out += [(anchor, positive, r + 1, n, p, s) for r, (s, n, _) in enumerate(fits)]
    return sorted(out, key=str)


def found(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def small_blocks(monkeypatch):
    """Many cells, blocks, leaves and chunks on small tables."""
    for name, value in (("BLOCK_ROWS", 32), ("LEAF_QUERIES", 3), ("CHUNK_LEAVES", 2), ("SMALL_LEAF", 8), ("SAMPLE_ROWS", 200)):
        monkeypatch.setattr(N, name, value)


def test_many_cells(spark, sf, small_blocks):
    same(QUERIES["op11_dual_tree"](spark, sf), duck(sf).sql(ORACLE_SQL["op11_dual_tree"]))


def test_clusters_copies_ties_and_odd_rows(spark, tmp_path, small_blocks):
    rng = np.random.default_rng(1)
    spots = rng.normal(size=(6, 8))
    rows = [(i, int(rng.integers(0, 4)), (spots[i % 6] + 0.05 * rng.normal(size=8)).round(2).tolist()) for i in range(500)]
    rows += [(1000 + i, i % 3, spots[0].round(2).tolist()) for i in range(150)]  # a hot copy in one cell, tied
    rows += [(None, 1, spots[1].tolist()), (None, 2, [0.5, 0.25]), (100, 1, spots[2].tolist()), (200, None, spots[2].tolist()), (300, 1, None)]
    rows += [(400, 2, [float("nan")] * 8), (401, 2, [float("inf")] * 8), (402, 2, [None] * 8), (3000, 1, []), (3001, 7, [-1.0] * 8), (3100, 8, [-1.0] * 8), (3200, 9, [1.0] * 8)]
    rows = [(i, l, v if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, l, v in rows]
    path = str(tmp_path)
    df = pd.DataFrame(rows, columns=["vec_id", "label", "embedding"]).astype({"vec_id": "Int64", "label": "Int32"}).assign(row=1, cell="x", vector=None)
    df.to_parquet(f"{path}/embeddings.parquet")
    shifted = [(i, (l + 1) % 10 if l is not None and i is not None and i % 7 == 0 else l, v) for i, l, v in rows]
    assert found(QUERIES["op11_dual_tree"](spark, path)) == brute(shifted)
    df.iloc[:0].to_parquet(f"{path}/embeddings.parquet")
    assert found(N.hard_negatives(spark.createDataFrame([], "vec_id long, label int, embedding array<float>"))) == []


def test_intervals_hold_all_products_and_prune():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(40, 5)) + 3, rng.normal(size=(50, 5)) * 0.2 - 2
    a, b = N.small_tree(x, np.zeros(40)), N.small_tree(y, np.zeros(50))
    low, high = N.interval(a.center[None], np.array([a.radius]), b.center[None], np.array([b.radius]))
    assert low[0, 0] <= (x @ y.T).min() and (x @ y.T).max() <= high[0, 0]
    spots = np.repeat(np.eye(8) * 100, 64, 0) + rng.normal(size=(512, 8)) * 0.1
    tree = N.fit_tree(spots, 512 * N.BLOCK_ROWS // 64, 8)
    cell = tree.cells(spots)
    cells = pd.DataFrame([{"cell": c, "far": np.linalg.norm(spots[cell == c] - tree.centers[c], axis=1).max(), "n": 1, "low": 0, "high": 1} for c in np.unique(cell)])
    reached = set(N.Balls.of(tree, cells).reached(spots[:4], np.zeros(4), np.full((4, 1), 9000.0), np.full((4, 1), 1e9), True))
    assert reached and len(reached) < len(cells) / 2
