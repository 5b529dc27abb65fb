"""Blocks of queries on M-trees, against brute force over Python integers, and the plan of the search."""

import math

import numpy as np
import pytest

from channelspark.llm import top_k


def brute_force(ids, vectors, queries, k):
    found = []
    for own, q in queries:
        scores = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in zip(ids, vectors) if i != own)
        found.append([(-s, i) for s, i in scores[:k]])
    return found


def answers(tree, queries, own, k):
    asks, scores, ids = tree.search_block(queries, own, k)
    return [[(s, i) for a, s, i in zip(asks.tolist(), scores.tolist(), ids.tolist()) if a == n] for n in range(len(queries))]


@pytest.mark.parametrize(("size", "kind"), [(30, np.float32), (10_000, np.float64), (3 * 10**7, np.int64), (10**12, object), (10**180, object)])
def test_a_block_of_queries_gets_the_exact_best(size, kind):
    r = np.random.default_rng(21)
    small = r.integers(-3, 4, (1500, 6)) if kind is np.float32 else r.integers(-30, 31, (1500, 6))
    points = np.array([[x * size // 3 for x in v] for v in small.tolist()], np.int64 if size < 10**12 else object)
    points = np.concatenate([points, points[:200]])
    ids = np.concatenate([r.permutation(1500), np.arange(1400, 1600)])
    tree = top_k.MTree(ids, points, int(abs(points).max()))
    assert top_k.exact_type(4 * tree.bound) is kind
    asked = r.choice(len(ids), 60, replace=False)
    queries, own = np.concatenate([points[asked], 0 * points[:1]]), np.append(ids[asked], -1)
    want = brute_force(ids.tolist(), points.tolist(), list(zip(own.tolist(), queries.tolist())), 7)
    assert answers(tree, queries, own, 7) == want
    assert [tree.search(q, o, 7) for q, o in zip(queries, own)] == want


def test_fewer_rows_than_asked_for():
    tree = top_k.MTree(np.arange(3), np.array([[1, 0], [0, 2], [0, 0]]))
    assert answers(tree, np.array([[0, 0], [1, 1]]), np.array([0, 7]), 5) == [[(0, 1), (0, 2)], [(2, 1), (1, 0), (0, 2)]]


def test_a_block_leaves_out_what_its_queries_leave_out():
    r = np.random.default_rng(7)
    points = (1000 * (r.normal(size=(40, 1, 6)) + r.normal(scale=0.02, size=(40, 200, 6)))).reshape(-1, 6).astype(np.int64)
    tree = top_k.MTree(np.arange(8000), points)
    asked = np.arange(0, 8000, 40)
    for i in asked:
        tree.search(points[i], i, 10)
    alone, tree.computed = tree.computed, 0
    tree.search_block(points[asked], asked, 10)
    assert tree.computed < 0.25 * len(asked) * len(points) and tree.computed < 1.5 * alone


def test_components_are_scaled_exactly(spark):
    limit = 2.0**43
    rows = [(1, [0.5, -0.0003, -0.0]), (2, []), (3, [limit, 1.0]), (4, [math.nextafter(limit, 0.0)]), (5, [-limit]), (6, [1e308, -1e-308])]
    bad = [(10, None), (11, [None]), (12, [1.0, None]), (13, [math.nan, 1.0]), (14, [math.inf]), (15, [1.0, -math.inf]), (None, [1.0])]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got = {r.id: (r.v, r.wide) for r in top_k.scaled(table, "vec_id", "embedding", 1024).collect()}
    assert got == {i: ([math.floor(1024 * x) for x in v], None) if all(abs(x) < limit for x in v) else (None, v) for i, v in rows}


def test_shards_of_small_and_of_huge_components(spark, monkeypatch):
    """Trees and queries of all shards measure in the same unit."""
    monkeypatch.setattr(top_k, "SHARD", 2)
    rows = [(100, [0.0, 1.0]), (200, [-1.7e308, 1.0]), *[(i, [0.0, float(i)]) for i in range(1, 30)]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k.exact_top_k(table, k=4).collect())
    assert got == [(q, n + 1, 29 - n, (29 - n) << 20) for q in (100, 200) for n in range(4)]


def test_copies_of_one_vector_in_several_shards(spark, monkeypatch):
    monkeypatch.setattr(top_k, "SHARD", 150)
    table = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(1000, 2000)], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k.exact_top_k(table).collect())
    assert got == [(q, n + 1, i, 5 << 20) for q in range(1000, 2000, 100) for n, i in enumerate([i for i in range(1000, 1011) if i != q][:10])]


def nodes(plan):
    found = [plan]
    for i in range(plan.children().size()):
        found += nodes(plan.children().apply(i))
    return found


def test_points_are_shuffled_once_and_as_they_are_read(spark, monkeypatch):
    """Neither copied for each block of queries nor grouped; each shard is a task of its own."""
    monkeypatch.setattr(top_k, "SHARD", 100)
    monkeypatch.setattr(top_k, "BLOCK", 2)
    table = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(700)], "vec_id long, embedding array<float>")
    plan = nodes(top_k.exact_top_k(table)._jdf.queryExecution().sparkPlan())
    union = next(n for n in plan if n.nodeName() == "Union")
    points = {n.nodeName().split()[0] for n in nodes(union.children().apply(0))}
    assert points <= {"Project", "Filter", "Scan"}
    above = [n for n in plan if n.nodeName() == "Exchange" and any(x.nodeName() == "Union" for x in nodes(n))]
    assert [n.outputPartitioning().numPartitions() for n in above] == [7]
    assert [n.nodeName() for n in plan].count("Window") == 1
