import numpy as np
import pytest

from corpusloom.llm import neighbours


def brute(rows, k=10):
    seen = {}
    for key, v in rows:
        if key is not None and v is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v):
            seen.setdefault(key, v)
    ids = np.array(sorted(seen))
    x = np.array([seen[i] for i in ids], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = np.round(x @ x.T, 6)
    np.fill_diagonal(s, -9)
    return {int(i): [int(ids[j]) for j in np.lexsort((ids, -s[r]))[: min(k, len(ids) - 1)]] for r, i in enumerate(ids)}


@pytest.mark.parametrize("block", [8192, 7])
def test_exact_when_there_is_one_cell(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(16).astype(np.float16).tolist()) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(14)] + [(200, rows[1][1]), rows[3], rows[3]]
    rows += [(300, None), (301, [0.0] * 16), (302, [1.0] * 8), (303, [float("nan")] * 16), (None, rows[2][1]), (304, [None] * 16), (305, [float("inf")] + [1.0] * 15)]
    df = spark.createDataFrame(rows, "chunk_id bigint, embedding array<float>").selectExpr("chunk_id", "embedding", "1 AS id", "2 AS near", "3 AS cell")
    got = {r["id"]: r["near"] for r in neighbours.nearest(df, "chunk_id", "embedding", width=16).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    right = sum(len(set(got[i]) & set(want[i])) for i in want)
    assert right >= 0.99 * sum(map(len, want.values()))
    assert got[100] == want[100] and got[0] == want[0]


def test_recall_with_cells(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 16))
    rows = [(i, (centres[i % 40] + 0.5 * rng.standard_normal(16)).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "chunk_id bigint, embedding array<float>")
    got = {r["id"]: r["near"] for r in neighbours.nearest(df, "chunk_id", "embedding", width=16, cell=256).collect()}
    want = brute(rows)
    right = sum(len(set(got[i]) & set(want[i])) for i in want)
    assert len(got) == 3000 and right >= 0.9 * 30_000


def test_recall_with_two_levels(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(neighbours, "replace", lambda r, **more: seen.append(r) or __import__("dataclasses").replace(r, **more))
    built = neighbours._second_level
    monkeypatch.setattr(neighbours, "_second_level", lambda *a: seen.append(built(*a)) or seen[-1])
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((60, 16))
    rows = [(i, (centres[i % 60] + 0.4 * rng.standard_normal(16)).tolist()) for i in range(5000)]
    df = spark.createDataFrame(rows, "chunk_id bigint, embedding array<float>")
    got = {r["id"]: r["near"] for r in neighbours.nearest(df, "chunk_id", "embedding", width=16, cell=80, sample=512).collect()}
    want = brute(rows)
    right = sum(len(set(got[i]) & set(want[i])) for i in want)
    levels = seen[0]
    assert len(levels.below) == 16 and sum(len(b.bias) for b in levels.below.values()) >= 32
    assert len(got) == 5000 and all(len(n) == 10 for n in got.values()) and right >= 0.9 * 50_000


def test_shut_cells_of_two_levels_get_nothing():
    x = np.random.default_rng(5).standard_normal((400, 8)).astype(np.float32)
    top = neighbours.learn(x, 4)
    below = {c: neighbours.learn(x[top.odds(x).argmax(1) == c], 2) for c in (0, 1, 2)}
    levels = neighbours.Levels(top, below, np.array([0, 2, 4, 6]), shut=(1, 6), spare=0)
    cells, count = levels.choose(x, 3)
    assert count.min() >= 1 and count.max() <= 3 and count.sum() == len(cells) and set(cells) <= {0, 2, 3, 4, 5}


def test_parts_are_balanced():
    x = np.random.default_rng(3).standard_normal((512, 8)).astype(np.float32)
    parts = neighbours.balanced_parts(neighbours.graph(x, 6), 3)
    assert np.bincount(parts).tolist() == [64] * 8


def test_equal_similarities_rank_by_id():
    rng = np.random.default_rng(4)
    v = rng.standard_normal(16)
    x = np.array([v * c for c in np.linspace(0.5, 3, 40)] + list(rng.standard_normal((20, 16))), np.float32)
    ids = np.concatenate([rng.permutation(40), np.arange(100, 120)])
    unit = neighbours._units(x)[1]
    near, _ = neighbours.best_within(ids, unit, ids, unit, 10)
    assert all(near[r].tolist() == [i for i in range(11) if i != ids[r]][:10] for r in range(40))


def test_packing_keeps_every_number():
    x = np.random.default_rng(5).standard_normal((6, 16)).astype(np.float32)
    x[1] = np.rint(x[1] * 8) / 8
    x[2, 0] = 1e30
    assert (neighbours.unpacked(neighbours.packed(x), 16) == x).all()


def test_a_scant_cell_is_filled_up(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((64, 16)).astype(np.float32)
    x[:3, 0] = 30
    weights = np.zeros((16, 2), np.float32)
    weights[0] = [-1, 1]
    monkeypatch.setattr(neighbours, "learn", lambda *_: neighbours.Router(np.zeros(16, np.float32), np.eye(16, dtype=np.float32), weights, np.array([20, -20], np.float32)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id bigint, embedding array<float>")
    got = neighbours.nearest(df, "chunk_id", "embedding", width=16).collect()
    assert len(got) == 64 and all(len(r["near"]) == 10 for r in got)


def test_few_rows(spark):
    empty = spark.createDataFrame([], "chunk_id bigint, embedding array<float>")
    assert neighbours.nearest(empty, "chunk_id", "embedding", width=16).collect() == []
    one = spark.createDataFrame([(1, [1.0] * 16)], "chunk_id bigint, embedding array<float>")
    assert neighbours.pairs(neighbours.nearest(one, "chunk_id", "embedding", width=16)).collect() == []


def test_first_level_stays_coarse_and_sees_enough():
    assert [neighbours.first_level(w, 256) for w in (0, 1, 236, 511, 512, 2302, 100_000)] == [(1, False), (1, False), (128, False), (256, False), (8, True), (32, True), (256, True)]
    x = np.random.default_rng(9).standard_normal((8192, 256)).astype(np.float32)
    router = neighbours.learn(x, 4)
    z = (x - router.mean) @ router.directions + router.bias
    odds = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    assert router.directions.shape == (256, 4) and np.allclose(router.odds(x), odds, atol=1e-4)
