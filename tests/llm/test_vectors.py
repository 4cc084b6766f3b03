"""Exact and approximate search against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlake.llm.ball_tree import NONE, Tree, build_tree, search_tree, top_k, whole_numbers
from pairlake.llm.hnsw import LINKS, build_graph, directions, nearest, search_graph

SCHEMA = "vec_id long, embedding array<float>, label int"
ODD = [
    (900, None, 0), (901, [], 0), (902, [1.0, None], 0), (903, [float("nan"), 1.0], 0),
    (904, [float("inf"), 1.0], 0), (None, [1.0, 2.0], 0), (905, [1.0, 2.0, 3.0], 0), (905, [1.0, 2.0, 3.0], 0),
]


def table(spark, matrix, more=()):
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows + list(more), SCHEMA)


@pytest.mark.parametrize("kind", ["random", "copies", "huge"])
def test_top_k_is_exact(spark, kind):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(400, 8)).astype(np.float32)
    if kind == "copies":
        m[100:300] = m[5]
    scale = 64.0 if kind != "huge" else 2.0**29
    df = table(spark, m, ODD)
    whole = whole_numbers(df, scale)
    got = top_k(whole, whole.filter("vec_id % 20 = 0"), 20, shard_rows=90, block_rows=7).collect()
    e = np.floor(scale * m.astype(np.float64)).astype(np.int64)
    want = []
    for q in range(0, 400, 20):
        scores = [(-int(e[q] @ e[c]), c) for c in range(400) if c != q]
        want += [(q, r, c, -s) for r, (s, c) in enumerate(sorted(scores)[:20], 1)]
    found = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got)
    assert [f for f in found if f[0] != 905] == want


def test_subtrees_below_the_known_score_are_not_looked_at():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(16, 6)) * 1000
    points = np.floor(centres[np.arange(4096) % 16] + rng.normal(size=(4096, 6))).astype(np.int64)
    order, *tree = build_tree(points)
    names = ["centres", "radii", "parents", "leaf_nodes", "leaf_starts"]
    row = {n: np.ascontiguousarray(x).tobytes() for n, x in zip(names, tree, strict=True)}
    index = Tree(row | {"ids": order.tobytes(), "matrix": points[order].tobytes()})
    q_ids = np.arange(0, 4096, 64)
    nothing = np.full(len(q_ids), NONE)
    scores, found, bounded = search_tree(index, q_ids, points[q_ids], nothing, 5)
    every = points[q_ids] @ points.T
    every[np.arange(len(q_ids)), q_ids] = np.iinfo(np.int64).min
    assert (scores == np.sort(every, axis=1)[:, ::-1][:, :5]).all()
    assert bounded < 0.5 * len(q_ids) * len(index.radii)
    # With the k-th score from elsewhere still less is opened, and nothing at all above the best.
    again, _, fewer = search_tree(index, q_ids, points[q_ids], scores[:, -1].copy(), 5)
    assert (again == scores).all() and fewer <= bounded
    none, _, least = search_tree(index, q_ids, points[q_ids], np.full(len(q_ids), 2**62), 5)
    assert (none == NONE).all() and least == len(q_ids)


def test_scores_beyond_64_bits(spark):
    rows = [(0, [1e17, 1.0], 0), (1, [1e17, 2.0], 0), (2, [-1e17, 0.0], 0), (3, [1e30, 0.0], 0), (4, [2.0, 3.0], 0)]
    df = whole_numbers(spark.createDataFrame(rows, SCHEMA), 1.0)
    got = [tuple(r)[2:] for r in sorted(top_k(df, df.filter("vec_id = 0"), 20, shard_rows=2).collect())]
    top, low = 2**63 - 1, -(2**63) + 1
    big = int(np.float64(np.float32(1e17)))
    assert got == [(1, top), (3, top), (4, 2 * big + 3), (2, low)]


def test_fewer_candidates_than_k(spark):
    df = whole_numbers(table(spark, np.eye(3, 2)), 1.0)
    got = sorted(map(tuple, top_k(df, df.filter("vec_id = 0"), 20).collect()))
    assert got == [(0, 1, 1, 0), (0, 2, 2, 0)]
    none = df.filter(F.lit(False))
    assert top_k(none, none, 3).collect() == [] and top_k(df, none, 3).collect() == []


@pytest.mark.parametrize("kind", ["random", "cluster", "copies"])
def test_recall_of_the_graph(spark, kind):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(1500, 16)).astype(np.float32)
    if kind == "cluster":
        m[300:900] = m[7] + 1e-3 * rng.normal(size=(600, 16))
    if kind == "copies":
        m[300:900] = m[7]
    m[11] = 0
    d = directions(table(spark, m, ODD))
    got = {}
    for r in nearest(d, d.filter("vec_id % 50 = 0"), 5, shard_rows=400).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    u = m.astype(np.float64)
    norm = np.sqrt((u**2).sum(axis=1))
    hits = total = 0
    for q in range(0, 1500, 50):
        with np.errstate(invalid="ignore", divide="ignore"):
            sims = (u @ u[q]) / (norm * norm[q])
        sims[[q, 11]] = -2
        rows = sorted(got[q])
        assert [r for r, _, _ in rows] == [1, 2, 3, 4, 5]
        assert [s for _, _, s in rows] == sorted((s for _, _, s in rows), reverse=True)
        kth = np.sort(sims)[-5]
        for _, c, s in rows:
            assert c not in (q, 11) and s == pytest.approx(sims[c], abs=1e-12)
            hits += s >= kth - 1e-12
            total += 1
        if kind == "copies" and 300 <= q < 900:
            assert [c for _, c, _ in rows] == sorted({7, 300, 301, 302, 303, 304, 305} - {q})[:5]
    assert hits / total >= 0.95


def test_graph_grows_by_walking():
    rng = np.random.default_rng(6)
    points = rng.normal(size=(1200, 12))
    points /= np.sqrt((points**2).sum(axis=1, keepdims=True))
    entry, sizes, members, neighbours = build_graph(np.arange(1200), points)
    assert sizes[0] == 1200 and sizes == sorted(sizes, reverse=True) and entry in members[-1]
    for level, (held, links) in enumerate(zip(members, neighbours, strict=True)):
        assert links.shape == (len(held), 2 * LINKS if level == 0 else LINKS)
        known = set(held.tolist())
        for node, row in zip(held.tolist(), links.tolist(), strict=True):
            there = [x for x in row if x >= 0]
            assert node not in there and len(set(there)) == len(there) and set(there) <= known
            assert there or len(held) == 1
    sims, nodes = search_graph(points, entry, members, neighbours, points[:200], 96)
    best = np.argsort(-(points[:200] @ points.T), axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b[:5])) / 5 for a, b in zip(best.tolist(), nodes.tolist(), strict=True)]) > 0.97


def test_nothing_to_find(spark):
    d = directions(table(spark, np.eye(2)))
    assert nearest(d, d.filter(F.lit(False)), 5).collect() == []
    alone = d.filter("vec_id = 0")
    assert nearest(alone, alone, 5).collect() == []
    assert nearest(d, alone, 5).collect()[0]["score"] == 0.0
