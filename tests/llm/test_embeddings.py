"""Embedding near-duplicates against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from test_simhash import brute_components  # noqa: F401

from sheetmill.llm import embeddings as E


def brute(rows, least=0.9):
    good, x = [], []
    for k, (_, v) in enumerate(rows):
        if v is None or any(c is None or not np.isfinite(c) for c in v) or not any(v):
            continue
        good.append(k)
        v = np.array(v, float)
        x.append(v / np.linalg.norm(v))
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, i in enumerate(good):
        for b, j in enumerate(good[:a]):
            if len(x[a]) == len(x[b]) and x[a] @ x[b] >= least:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(rows[k][0])
    return [(rows[k][0], links[k], min(groups[find(k)])) for k in range(len(rows))]


@pytest.mark.parametrize("stored", [4096, 7])
def test_against_brute_force(spark, monkeypatch, stored):
    monkeypatch.setattr(E, "STORED", stored)
    monkeypatch.setattr(E, "QUERIES", 16)
    rng = np.random.default_rng(4)
    rows = []
    for c in rng.normal(size=(40, 16)):
        for _ in range(rng.integers(1, 9)):
            rows.append((len(rows), [float(v) for v in np.float32(c + rng.normal(size=16) * rng.choice([0, 0.05, 0.2]))]))
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [float("inf")] + [1.0] * 15), (904, [None] + [1.0] * 15), (905, [])]
    rows += [(906, [1.0, 2.0]), (907, [2.0, 4.0]), (908, [float(np.float32(1e-30)) * v for v in (1, 2)]), (909, rows[0][1]), (910, [2 * v for v in rows[0][1]])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, node string").repartition(3)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in E.near_vectors(df).collect())
    want = sorted(brute(rows))
    assert got == want and sum(w[1] for w in want) > 100


def test_a_tight_group_of_a_third_keeps_all_links(spark):
    """Noisy vectors, 20,000 and more, of which one group holds a third, and isolated pairs at the bound."""
    rng = np.random.default_rng(11)
    n, dim = 21_000, 64
    x = rng.normal(size=(n, dim))
    centre = rng.normal(size=dim)
    x[: n // 3] = centre / np.linalg.norm(centre) + 0.035 * rng.normal(size=(n // 3, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = x[-1000::2], x[-999::2]
    b -= (a * b).sum(axis=1, keepdims=True) * a
    x[-999::2] = 0.901 * a + np.sqrt(1 - 0.901**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    x = x.astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": list(x)})).repartition(8)
    got = E.near_vectors(df).select("vec_id", "n_links").toArrow().sort_by("vec_id").column("n_links").to_numpy()
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    want = np.concatenate([(y[k : k + 1000] @ y.T >= 0.9).sum(axis=1) - 1 for k in range(0, n, 1000)])
    assert want[: n // 3].mean() > 500 and (want[-1000:] > 0).all()
    assert got.sum() / want.sum() == 1.0 and (got == want).all()


def test_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, E.near_vectors(df).collect())) == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]
    assert E.near_vectors(df.limit(0)).collect() == []


def test_code_distance_is_off_by_the_code_error_at_most():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = E.Quantiser(x, len(x))
    centre = q.centres[0]
    codes, error = q.encode(x - centre)
    exact = np.linalg.norm(x[:50, None] - x[None], axis=2)
    assert (np.abs(q.distances(x[:50] - centre, codes) - exact) <= error + 1e-9).all()
