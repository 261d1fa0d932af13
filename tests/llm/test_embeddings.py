import math
from collections import Counter

import numpy as np

from shelfwise.llm import embeddings as E

SCHEMA = "vec_id long, embedding array<float>, label int, node string, size int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], SCHEMA)


def vectors(rng, n, clusters, noise):
    out = []
    for k in range(n):
        if k % 3:
            v = clusters[k % len(clusters)] + noise * rng.standard_normal(clusters.shape[1])
        else:
            v = rng.standard_normal(clusters.shape[1])
        out.append([float(x) for x in np.float32(v)])
    return out


def brute(rows):
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, np.float64)
        return np.pad(v, (0, 16 - len(v))) / np.linalg.norm(v)

    x = [unit(v) if i is not None and label is not None else None for i, v, label in rows]
    n = len(rows)
    link = [[b for b in range(n) if b != a and x[a] is not None and x[b] is not None and rows[a][2] == rows[b][2] and x[a] @ x[b] >= 0.98] for a in range(n)]
    group = list(range(n))
    for _ in range(n):
        fresh = [min([group[a], *(group[b] for b in link[a])]) for a in range(n)]
        if fresh == group:
            break
        group = fresh
    best = {}
    for a in range(n):
        if rows[a][0] is not None:
            best[group[a]] = min(best.get(group[a], rows[a][0]), rows[a][0])
    return [(rows[a][0], len(link[a]), None if rows[a][0] is None else best[group[a]]) for a in range(n)]


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 16)
    monkeypatch.setattr(E, "QUERY_BLOCK", 20)
    rng = np.random.default_rng(1)
    some = vectors(rng, 240, rng.standard_normal((6, 16)), 0.08)
    rows = [(1000 - k, v, k % 2) for k, v in enumerate(some)]
    one = [1.0, 2.0, 3.0]
    rows += [(2, one, 1), (1, one, 1), (3, [2.0, 4.0, 6.0], 1), (4, one, 2), (5, one, None), (None, one, 1), (6, None, 1), (7, [], 1), (8, [0.0] * 16, 1),
             (9, [1.0, None], 1), (10, [float("nan"), 1.0], 1), (11, [float("inf"), 1.0], 1), (12, [1e-30, 2e-30, 3e-30], 1)]
    got = [(r.vec_id, r.n_links, r.component_id) for r in E.near_vectors(table(spark, rows)).collect()]
    assert Counter(got) == Counter(brute(rows))


def test_empty_and_useless_tables(spark):
    assert E.near_vectors(table(spark, [])).count() == 0
    assert [tuple(r) for r in E.near_vectors(table(spark, [(1, None, 1)])).collect()] == [(1, 0, 1, True)]


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(3)
    some = vectors(rng, 3000, rng.standard_normal((300, 64)), 0.13)
    rows = [(k, v, 0) for k, v in enumerate(some)]
    x = np.array(some)
    x /= np.linalg.norm(x, axis=1)[:, None]
    true = int((x @ x.T >= 0.98).sum()) - len(x)
    got = sum(r.n_links for r in E.near_vectors(table(spark, rows)).collect())
    assert true > 1000 and 0.99 * true <= got <= true
