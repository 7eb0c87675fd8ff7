"""Near-duplicate vectors against all pairs."""

import duckdb
import numpy as np
import pytest

from tmloom.llm import flat_graph as g
from tmloom.llm.queries import ORACLES


def by_all_pairs(rows, least=0.93):
    ok = [
        k for k, (_, v, label) in enumerate(rows)
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    links = {k: [] for k in range(len(rows))}
    sites = {}
    for k in ok:
        sites.setdefault((rows[k][2], len(rows[k][1])), []).append(k)
    for ks in sites.values():
        x = np.array([rows[k][1] for k in ks], np.float64)
        norm = np.linalg.norm(x, axis=1)
        near = x @ x.T / (norm[:, None] * norm) >= least
        for a, b in zip(*np.nonzero(near), strict=True):
            if a != b:
                links[ks[a]].append(ks[b])
    root = {}
    for k in links:
        if k in root:
            continue
        seen, todo = {k}, [k]
        while todo:
            for b in links[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        ids = [rows[b][0] for b in seen if rows[b][0] is not None]
        for b in seen:
            root[b] = min(ids, default=None)
    return [(rows[k][0], len(links[k]), root[k], rows[k][0] == root[k]) for k in links]


def planted(seed, n, dims, groups):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    at = 0
    for size, spread in groups:
        x[at + 1 : at + size] = x[at] + spread * rng.normal(size=(size - 1, dims))
        at += size
    order = rng.permutation(n)
    labels = np.where(np.arange(n) < at, 1, rng.integers(1, 4, n))
    return [(int(k), x[i].astype(np.float32).tolist(), int(labels[i])) for k, i in enumerate(order)]


ODD = [(None, None, 1), (7, None, 2), (900_001, [0.0] * 16, 1), (900_002, [float("nan")] * 16, 1), (900_003, [1.0, None], 1),
       (900_004, [], 2), (900_005, [1.0] * 16, None), (900_006, [1.0] * 16, 1), (900_007, [2.0] * 16, 1),
       (None, [1.0] * 16, 1), (900_008, [1.0] * 3, 1), (900_009, [float("inf")] + [0.0] * 15, 3)]


@pytest.mark.parametrize("most", [4096, 256])
def test_links_and_components(spark, monkeypatch, most):
    monkeypatch.setattr(g, "MOST_NODES", most)
    monkeypatch.setattr(g, "SHARD_NODES", most // 4)
    monkeypatch.setattr(g, "ROWS_OF_A_SALT", 500)
    rows = planted(1, 3000, 16, [(700, 0.02), (40, 0.1), (9, 0.2), (300, 0.25), (2, 0.1)])
    rows += [(100_000 + k, *rows[5][1:]) for k in range(50)] + rows[:20] + ODD
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr(
        "*", "'own' as node", "1 as shard", "2 as n_links", "3 as row"
    )
    got = sorted(map(tuple, g.near_vectors(df).collect()), key=repr)
    want = sorted(by_all_pairs(rows), key=repr)
    assert len(got) == len(want)
    found, true = sum(r[1] for r in got), sum(r[1] for r in want)
    assert 0.999 * true <= found <= true
    if most == 4096:
        assert got == want
    assert g.near_vectors(df.limit(0)).count() == 0


def test_large_dense_group_is_whole(spark, monkeypatch):
    """One group of near copies holds most rows and far more than a task takes."""
    monkeypatch.setattr(g, "MOST_NODES", 200)
    monkeypatch.setattr(g, "SHARD_NODES", 50)
    rows = [(k, v, 1) for k, v, _ in planted(2, 1500, 16, [(1200, 0.01)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, g.near_vectors(df).collect())) == sorted(by_all_pairs(rows))


def test_pruning_keeps_the_nearest_and_drops_what_it_covers():
    rng = np.random.default_rng(3)
    unit = rng.normal(size=(120, 8))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links = g.pruned(unit, degree=6, listed=30)
    angle = np.arccos(np.clip(unit @ unit.T, -1, 1))
    for p in range(len(unit)):
        left = [c for c in np.argsort(angle[p], kind="stable") if c != p][:30]
        want = []
        while left and len(want) < 6:
            want.append(left.pop(0))
            left = [c for c in left if g.ALPHA * angle[want[-1], c] > angle[p, c]]
        assert [c for c in links[p] if c >= 0] == want


def test_sql_says_the_same(spark, tmp_path):
    rows = planted(4, 400, 16, [(30, 0.05), (5, 0.1)]) + [r for r in ODD if r[0] is not None]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(db.execute(ORACLES["op12_near_vectors"]).fetchall(), key=repr) == sorted(by_all_pairs(rows), key=repr)
