import helpers
import numpy as np
import pytest

from laurel.llm import components, near_vectors


def brute(rows, threshold=0.9):
    good = [i for i, (k, v) in enumerate(rows) if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    dims = max([len(rows[i][1]) for i in good], default=0)
    x = np.array([[*rows[i][1], *[0.0] * (dims - len(rows[i][1]))] for i in good], float).reshape(len(good), dims)
    x /= np.linalg.norm(x, axis=1, keepdims=True) if len(x) else 1
    link, sets = x @ x.T >= threshold, helpers.Sets()
    for a in range(len(good)):
        for b in np.flatnonzero(link[a]):
            sets.join(rows[good[a]][0], rows[good[b]][0])
    n = dict(zip(good, link.sum(axis=1) - 1 if len(good) else [], strict=True))
    return helpers.plain((k, int(n.get(i, 0)), sets.find(k) if i in n else k, k is not None and k == (sets.find(k) if i in n else k)) for i, (k, _) in enumerate(rows))


def vectors(seed=1, dims=24):
    rng = np.random.default_rng(seed)
    rows, key = [], 0
    for size in [1] * 200 + [2] * 40 + [150]:
        centre = rng.normal(size=dims)
        for _ in range(size):
            rows.append((key * 3 % 1000, (centre + 0.25 * rng.normal(size=dims)).astype(np.float32).tolist()))
            key += 1
    rows += [(2000 + i, rows[0][1]) for i in range(30)] + [(2100, [2 * x for x in rows[1][1]])]
    rows += [(3000, None), (3001, []), (3002, [0.0] * dims), (3003, [float("nan")] * dims), (3004, [None, *[1.0] * (dims - 1)]), (3005, [float("inf"), 1.0]), (3006, [1.0]), (3007, [5.0]), (None, rows[0][1]), (3008, [1e30] * dims), (3009, [1e-30] * dims)]
    return rows


@pytest.mark.parametrize("small_groups", [False, True])
def test_links_and_components(spark, monkeypatch, small_groups):
    if small_groups:
        monkeypatch.setattr(near_vectors, "GROUP_ROWS", (32, 64))
    rows = vectors()
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "vec_id long, embedding array<float>, label int, h1 string").repartition(4)
    assert helpers.plain(near_vectors.near_duplicates(df).collect()) == brute(rows)


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<double>")
    assert helpers.plain(near_vectors.near_duplicates(df).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert near_vectors.near_duplicates(df.limit(0)).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 200)] + [(500, 500), (601, 600), (600, 601), (None, 5), (700, 39)]
    sets = helpers.Sets()
    for a, b in links:
        if a is not None and a != b:
            sets.join(a, b)
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: sets.find(x) for x in sets.up if sets.find(x) != x}
    a, b = np.array([3, 1, 5, 7]), np.array([1, 5, 9, 8])
    assert components.forest(a, b, 10).tolist() == [0, 1, 2, 1, 4, 1, 6, 7, 7, 1]
