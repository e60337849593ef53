"""Embedding near-dedup and exact top-k against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from quern.llm import graph, topk
from quern.llm.queries import ORACLES, QUERIES
from tests.conftest import SMALL


def unit(rng, n=8):
    v = np.array([rng.gauss(0, 1) for _ in range(n)])
    return v / np.linalg.norm(v)


def odd_vectors(rng, groups=12):
    rows, k = [], 0
    for g in range(groups):
        base = unit(rng)
        for _ in range(rng.choice((1, 2, 9, 30))):
            v = base + rng.choice((0, 0.03, 0.12)) * unit(rng)
            rows.append((k, [float(x) for x in np.float32(v * rng.choice((1, 1, 3)))]))
            k += 1
    rows += [(k, None), (k + 1, []), (k + 2, [0.0] * 8), (k + 3, [1.0] * 7 + [None]), (k + 4, [float("nan")] + [0.0] * 7), (k + 5, [float("inf")] + [0.0] * 7), (None, rows[0][1])]
    return rows + [(k + 6, [1.0, 0.0]), (k + 7, [1.0, 0.001]), (k + 100, rows[3][1]), (k + 100, rows[3][1])]


def good(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def brute_links(rows, cosine=0.95):
    take = [(i, k, np.array(v) / np.linalg.norm(v)) for i, (k, v) in enumerate(rows) if k is not None and good(v) and any(v)]
    links, root = {}, {k: k for k, _ in rows if k is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a, x in take:
        near = [b for j, b, y in take if i != j and len(x) == len(y) and x @ y >= cosine]
        links[i] = len(near)
        for b in near:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return [(k, links.get(i, 0), None if k is None else find(k)) for i, (k, v) in enumerate(rows)]


@pytest.mark.parametrize(("shard", "centres"), [(1000, 1024), (20, 1024), (20, 2)])
def test_links_as_by_brute_force(spark, monkeypatch, shard, centres):
    rows = odd_vectors(random.Random(shard))
    monkeypatch.setattr(graph, "SHARD", shard)
    monkeypatch.setattr(graph, "CENTRES", centres)
    monkeypatch.setattr(graph, "VISITS", 15)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as x", "2 as node", "'s' as shard")
    got = graph.near_duplicates(df).collect()
    expected = brute_links([(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for k, v in rows])
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=key) == sorted(expected, key=key)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) and r.audited_recall >= graph.RECALL for r in got)


@pytest.mark.parametrize("centres", [1024, 3])
def test_many_nodes_in_small_shards_keep_recall(spark, monkeypatch, centres):
    rng = random.Random(5)
    rows = [(i, [float(x) for x in unit(rng, 16)]) for i in range(600)]
    for g in range(20):
        base = unit(rng, 16)
        rows += [(1000 + g * 50 + i, [float(x) for x in base + 0.1 * unit(rng, 16)]) for i in range(40)]
    monkeypatch.setattr(graph, "SHARD", 50)
    monkeypatch.setattr(graph, "CENTRES", centres)  # of 3 centres, shards are split again
    got = {r.vec_id: r.n_links for r in graph.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    true = {k: n for k, n, _ in brute_links(rows)}
    assert all(got[k] <= true[k] for k in true) and sum(got.values()) >= 0.97 * sum(true.values()) > 0


def test_all_are_compared_where_the_search_misses(spark, monkeypatch):
    rows = odd_vectors(random.Random(7), 30)
    monkeypatch.setattr(graph, "SHARD", 20)
    monkeypatch.setattr(graph, "VISITS", 15)
    real, calls = graph.audit, []
    monkeypatch.setattr(graph, "audit", lambda *a, **k: calls.append(1) or (real(*a, **k) if len(calls) > 3 else 0.5))
    got = {(r.vec_id, r.n_links, r.component_id) for r in graph.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(calls) == 4 and got == set(brute_links(rows))


def test_greedy_search_on_a_pruned_graph_finds_the_range():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 12))
    x[:60] = x[0] + 0.15 * rng.normal(size=(60, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lists = graph.union_reverse(graph.prune(x))
    for i, found in enumerate(graph.search_all(x, lists, 250, x, 0.9)):
        assert set(found) == set(np.flatnonzero((x @ x[i]).astype(np.float32) >= 0.9 - 1e-5))


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert graph.near_duplicates(empty).collect() == [] and topk.every_nth(empty).collect() == []


def brute_topk(rows, k, nth):
    scaled = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            scaled.setdefault(i, []).append([math.floor(1024 * float(np.float32(x))) for x in v])
    out = []
    for q in sorted(i for i in scaled if i % nth == 0):
        query = min(scaled[q])
        scores = sorted((-max(sum(a * b for a, b in zip(query, v, strict=False)) for v in vs), i) for i, vs in scaled.items() if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return out


@pytest.mark.parametrize(("k", "nth", "queries"), [(10, 100, 4096), (3, 5, 4096), (4, 2, 7), (500, 50, 4096)])
def test_top_k_as_by_brute_force(spark, monkeypatch, k, nth, queries):
    rows = odd_vectors(random.Random(k))
    rows += [(900 + i, [float(-1)] * 8) for i in range(3)] + [(1000, [0.5] * 8), (1001, [0.5] * 8)]
    monkeypatch.setattr(topk, "QUERIES", queries)
    monkeypatch.setattr(topk, "HELD", 2000)
    monkeypatch.setattr(topk, "CHUNK", 30)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5).selectExpr("*", "1 as row", "2 as block", "3 as list", "4 as score", "5 as v")
    assert sorted(tuple(r) for r in topk.every_nth(df, nth, k).collect()) == brute_topk(rows, k, nth)


def test_top_k_beyond_doubles(spark):
    rows = [(0, [2.0**22, 2.0**21]), (1, [2.0**22, 1.0]), (2, [2.0**22 + 0.5, 1.0]), (3, [-(2.0**22), 5.0]), (4, [2.0**60, 2.0**60])]
    got = [tuple(r) for r in topk.every_nth(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 100, 10).collect()]
    scaled = {i: [math.floor(1024 * x) for x in v] for i, v in rows}
    expected = sorted((-max(-(2**63), min(2**63 - 1, sum(a * min(2**63 - 1, b) for a, b in zip(scaled[0], v, strict=True)))), i) for i, v in scaled.items() if i)
    assert sorted((r[1], r[2], r[3]) for r in got) == [(n + 1, i, -s) for n, (s, i) in enumerate(expected)]


@pytest.mark.parametrize("name", ["op3_embedding_near_dedup", "op8_exact_topk"])
def test_queries_match_sql(spark, same_rows, name):
    same_rows(QUERIES[name](spark, SMALL), ORACLES[name])
