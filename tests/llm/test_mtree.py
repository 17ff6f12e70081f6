"""The M-tree search against brute force."""

import math
import random

import numpy as np
import pytest

from quarrylake.llm import mtree

SCHEMA = "vec_id long, embedding array<float>, row string, vec string, cell int, copy int, score int"


def brute(rows, step=50, top=5):
    def whole(v):
        if v is None or any(c is None or not math.isfinite(c) for c in v):
            return None
        return [math.floor(256 * float(np.float32(c))) for c in v]

    held = [(i, whole(v)) for i, v in rows]
    held = [(i, v) for i, v in held if v is not None]
    out = []
    for a, (i, q) in enumerate(held):
        if i is None or i % step:
            continue
        scored = [(-sum(x * y for x, y in zip(q, v)), j is None, j or 0, j) for b, (j, v) in enumerate(held) if b != a]
        out += [(i, k + 1, j, -s) for k, (s, _, _, j) in enumerate(sorted(scored, key=lambda t: t[:3])[:top])]
    return sorted(out, key=str)


def search(spark, rows, parts=3, **kw):
    floats = lambda v: v and [c if c is None else float(c) for c in v]
    df = spark.createDataFrame([(i, floats(v), "r", "v", 1, 2, 3) for i, v in rows], SCHEMA).repartition(parts)
    return sorted(map(tuple, mtree.nearest(df, **kw).collect()), key=str)


def test_cases(spark, monkeypatch):
    monkeypatch.setattr(mtree, "CELL_ROWS", 40)
    monkeypatch.setattr(mtree, "TREE_ROWS", 30)
    monkeypatch.setattr(mtree, "ROUND_BYTES", 60)  # several rounds
    rng = random.Random(3)
    centers = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(k, [c + rng.gauss(0, 0.1) for c in rng.choice(centers)]) for k in range(400)]
    rows += [(1000 + k, [0.5, 0.5, 0.5, 0.5, 0.5, 0.5]) for k in range(150)]  # a hot vector, queries among its rows
    rows += [(50, rows[7][1]), (50, rows[50][1]), (50, rows[50][1])]  # repeated ids and rows
    rows += [(None, rows[50][1]), (None, [9.0] * 6), (2000, None), (2050, [1.0, None, 0, 0, 0, 0]), (2100, [float("nan")] * 6), (2150, [float("inf")] * 6)]
    rows += [(2200, []), (2250, [1.0, -1.0]), (2300, [0.0] * 6), (-50, [-0.001] * 6)]
    assert search(spark, rows) == brute(rows)
    assert search(spark, rows, parts=9, step=7, top=3) == brute(rows, 7, 3)


@pytest.mark.parametrize("rows", [[], [(50, None)], [(1, [1.0])], [(50, [1.0])], [(50, [1.0]), (50, [1.0])], [(0, []), (1, [])]])
def test_small_tables(spark, rows):
    assert search(spark, rows, 1) == brute(rows)


def test_large_components_are_exact(spark):
    rng = random.Random(5)
    rows = [(k, [rng.uniform(-8e6, 8e6) for _ in range(3)]) for k in range(60)]
    assert search(spark, rows, step=10) == brute(rows, 10)


def test_pages_cover_and_spare_products():
    rng = np.random.default_rng(1)
    centers = rng.normal(0, 100, (20, 16))
    x = np.floor(centers[rng.integers(0, 20, 1500)] + rng.normal(0, 5, (1500, 16)))
    pages = mtree.grow(x, x[0])
    norms = np.sqrt((x * x).sum(1))

    def below(node):
        page = pages[node]
        if page["leaf"]:
            return list(page["idx"])
        rows = []
        for k, child in enumerate(page["child"]):
            under = below(child)
            assert np.sqrt(((x[under] - x[page["idx"][k]]) ** 2).sum(1)).max() <= page["radius"][k] + 1e-6
            assert norms[under].max() <= page["norm"][k]
            rows += under
        return rows

    assert sorted(below(0)) == list(range(len(x)))
    assert max(len(p["idx"]) for p in pages) <= mtree.PAGE
    assert len(mtree.grow(np.ones((500, 4)), np.ones(4))) > 1  # equal rows are cut too
    stored = [
        {"leaf": p["leaf"], "objects": x[p["idx"]].astype(np.int32).tobytes(), "ref": np.asarray(p["idx"] if p["leaf"] else p["child"], np.int64).tobytes(), "id": np.asarray(p["idx"], np.int64).tobytes(), "null_id": bytes(len(p["idx"]))}
        | {c: np.asarray(p[c], np.float64).tobytes() for c in ("ahead", "radius", "norm")}
        for p in pages
    ]
    found = mtree.Search(x[:20], np.arange(20), np.full(20, mtree.NONE), 5)
    found.tree({"pages": stored, "radius": 1e9, "norm": norms.max()}, x[0])
    scores = x[:20] @ x.T
    scores[np.arange(20), np.arange(20)] = -np.inf
    assert (found.score == np.sort(scores, 1)[:, :-6:-1]).all()
    assert found.products < 0.6 * 20 * len(x)
