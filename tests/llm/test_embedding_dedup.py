import numpy as np
import pytest

from marketweave.llm import embedding_dedup
from marketweave.llm.common import components


def _vectors(seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((300, 16))
    near = x[:40] + 0.05 * rng.standard_normal((40, 16))
    cluster = x[50] + 0.12 * rng.standard_normal((400, 16))  # a hot bucket, not all of it linked
    return np.vstack([x, near, cluster, x[:5], x[:5], 3 * x[60:63]]).astype(np.float32)


def _expected(x):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    label = np.arange(len(x))
    while True:
        low = np.minimum(label, np.where(link, label[None, :], len(x)).min(axis=1))
        if (low == label).all():
            return link.sum(axis=1), label
        label = low


def test_links_and_components(spark):
    x = _vectors()
    frame = spark.createDataFrame([(i, v.tolist(), 1, "extra") for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int, id string")
    got = {r["vec_id"]: r for r in embedding_dedup.clusters(frame).collect()}
    links, label = _expected(x)
    assert len(got) == len(x)
    # a pair at the threshold is missed once in a thousand; those here lie well above or below it
    assert sum(got[i]["n_links"] for i in range(len(x))) >= 0.995 * links.sum()
    assert all(got[i]["n_links"] <= links[i] for i in range(len(x)))
    assert [got[i]["component_id"] for i in range(len(x))] == label.tolist()
    assert all(got[i]["kept"] == (label[i] == i) for i in range(len(x)))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [1.0, 0.0]), (10, [1.0, 0.0])]
    got = embedding_dedup.clusters(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(got) == len(rows)
    by = {r["vec_id"]: r for r in got}
    assert {i for i, r in by.items() if r["n_links"]} == {1, 2, 10}
    assert (by[1]["n_links"], by[2]["n_links"], by[10]["n_links"]) == (3, 3, 3)
    assert by[10]["component_id"] == 1 and by[3]["component_id"] == 3 and by[None]["component_id"] is None
    assert embedding_dedup.clusters(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_one_id_with_different_vectors(spark):
    rng = np.random.default_rng(2)
    a, b = rng.standard_normal(32), rng.standard_normal(32)
    rows = [(1, a), (1, b), (2, a + 0.01 * rng.standard_normal(32)), (3, b + 0.01 * rng.standard_normal(32)), (4, rng.standard_normal(32))]
    got = embedding_dedup.clusters(spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4)]


def test_double_precision_and_large_values(spark):
    angle = np.arccos(0.95 + 1e-9), np.arccos(0.95 - 1e-9)
    rows = [(1, [1.0, 0.0]), (2, [np.cos(angle[0]), np.sin(angle[0])]), (3, [0.0, 1e200]), (4, [1e150, 1e200]), (5, [-1e-200, 0.0]), (6, [-np.cos(angle[1]), np.sin(angle[1])])]
    # many pairs in one table each: signs are few, so tables tell all of them
    got = {r["vec_id"]: r for r in embedding_dedup.clusters(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")).collect()}
    assert [got[i]["n_links"] for i in range(1, 7)] == [1, 1, 1, 1, 0, 0]


def test_sketch_allows_links():
    rng = np.random.default_rng(7)
    x = embedding_dedup.unit_rows(rng.standard_normal((4000, 48)))
    y = rng.standard_normal((4000, 48))
    y = embedding_dedup.unit_rows(y - (x * y).sum(axis=1)[:, None] * x)
    pair = 0.95 * x + np.sqrt(1 - 0.95**2) * y
    apart = np.bitwise_count(embedding_dedup.sketches(x) ^ embedding_dedup.sketches(pair)).sum(axis=1)
    other = np.bitwise_count(embedding_dedup.sketches(x) ^ embedding_dedup.sketches(y)).sum(axis=1)
    assert apart.max() <= embedding_dedup.allowed(0.95) < other.min()


@pytest.mark.parametrize("n", [10, 10_000, 10**8])
def test_plan_misses_few(n):
    signs, tables = embedding_dedup.plan(n, 0.95)
    assert (1 - (1 - np.arccos(0.95) / np.pi) ** signs) ** tables <= embedding_dedup.MISS


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(7, 7), (9, 8)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 560)} | {8: 8, 9: 8}
    assert got == want
