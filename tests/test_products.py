"""Products of columns by tiles, with absent cells, against numpy and against the dense way."""

import numpy as np
import pytest

from netweave.operators import matrix, networks, products

N, SUBJECTS = 23, 31


@pytest.fixture(scope="module")
def sparse(spark):
    """A matrix with absent cells, with pairs of columns that share no subject, and a column that one class lacks."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(SUBJECTS, N)) * (rng.random((SUBJECTS, N)) < 0.25)
    x[:20, 3] = x[20:, 5] = 0
    x[::2, 7], x[1, 7] = 0, 0.5
    x[~x.any(axis=1), 22] = 1.5  # a subject without cells would not be there
    label = np.arange(SUBJECTS) % 2
    rows = [(f"s{s}", f"f{f:02d}", float(x[s, f]), int(label[s])) for s in range(SUBJECTS) for f in range(N) if x[s, f]]
    df = spark.createDataFrame(rows, "subject string, feature string, value double, label int")
    assert len({r[1] for r in rows}) == N
    return df, x, label


def upper(df, value="dot", a="f1", b="f2"):
    return {(r[a], r[b]): r[value] for r in df.collect()}


def assert_all_pairs(found, want, diagonal=True):
    names = [f"f{f:02d}" for f in range(N)]
    expected = {(names[i], names[j]): want[i, j] for i in range(N) for j in range(i if diagonal else i + 1, N)}
    assert found.keys() == expected.keys()
    assert max(abs(found[k] - expected[k]) for k in expected) < 1e-9


@pytest.mark.parametrize("tile, rows", [(512, 4096), (6, 7), (1, 40)])
def test_tiles_give_every_pair(sparse, tile, rows):
    df, x, _ = sparse
    own = df.select("subject", "feature", "value")
    assert_all_pairs(upper(products.column_pairs(own, tile=tile, rows=rows)), x.T @ x)
    if tile > 1:
        far = np.abs(x[:, :, None] - x[:, None, :])
        assert_all_pairs(upper(products.column_pairs(own, products.powers(3), tile=tile, rows=rows)), (far**3).sum(axis=0))
        assert_all_pairs(upper(products.column_pairs(own, products.largest, maximum=True, tile=tile, rows=rows)), far.max(axis=0))


@pytest.mark.parametrize("dense", [2048, 1])
def test_networks_keep_pairs_without_a_common_subject(sparse, dense, monkeypatch):
    df, x, label = sparse
    monkeypatch.setattr(products, "TILE", 8)
    monkeypatch.setattr(networks, "column_products", lambda m, where=None: matrix.column_products(m, where, dense))
    dots = x.T @ x
    norm = np.sqrt(np.diag(dots))
    square = np.diag(dots)[:, None] + np.diag(dots)[None, :] - 2 * dots
    one_way = lambda edges: upper(edges.where("src < dst"), "weight", "src", "dst")
    assert_all_pairs(one_way(networks.correlation(df)), np.abs(dots / np.outer(norm, norm)), False)
    assert_all_pairs(one_way(networks.heat_kernel(df, 3)), np.exp(-square / 6), False)
    assert_all_pairs(one_way(networks.heat_kernel(df, 3, order=1)), np.exp(-(np.abs(x[:, :, None] - x[:, None, :]).sum(axis=0) ** 2) / 6), False)
    assert_all_pairs(one_way(networks.heat_kernel(df, 3, order=float("inf"))), np.exp(-(np.abs(x[:, :, None] - x[:, None, :]).max(axis=0) ** 2) / 6), False)
    z = []
    for k in (0, 1):
        d = x[label == k].T @ x[label == k]
        n = np.where(np.diag(d) == 0, 1, np.sqrt(np.diag(d)))
        z.append(np.arctanh(np.clip(d / np.outer(n, n), -0.99999999, 0.99999999)))
    error = np.sqrt(1 / ((label == 0).sum() - 3) + 1 / ((label == 1).sum() - 3))
    assert_all_pairs(one_way(networks.fisher_difference(df)), np.abs(z[0] - z[1]) / error, False)


@pytest.mark.parametrize("sparse_cells", [1, 10**6])
def test_overlap_by_products_and_by_joins(spark, monkeypatch, sparse_cells):
    monkeypatch.setattr(networks, "SPARSE", sparse_cells)
    rng = np.random.default_rng(2)
    a = np.triu(rng.random((17, 17)) * (rng.random((17, 17)) < 0.2), 1)
    a += a.T
    edges = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(17) for j in range(17) if a[i, j]], "src long, dst long, weight double")
    k, shared = a.sum(axis=0), a @ a
    want = {(i, j): (shared[i, j] + a[i, j]) / (min(k[i], k[j]) + 1 - a[i, j]) for i in range(17) for j in range(17) if i != j and (shared[i, j] or a[i, j])}
    found = {(r.src, r.dst): r.weight for r in networks.topological_overlap(edges).collect()}
    assert found.keys() == want.keys() and max(abs(found[p] - want[p]) for p in want) < 1e-12


def test_no_cells(spark):
    none = spark.createDataFrame([], "subject long, feature long, value double")
    assert products.column_pairs(none).collect() == [] and networks.correlation(none).collect() == []
