"""Machines without one subject, by updates of the machine of all, against machines fitted anew."""

import numpy as np
import pytest

from netweave.functions import kernels
from netweave.operators import machines


def refitted(x, y):
    return [int(kernels.predict(np.delete(x, i, 0), np.delete(y, i), x[i : i + 1])[0]) for i in range(len(x))]


def noisy(seed, n, d, shift=0.6):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.4).astype(int)
    return rng.normal(size=(n, d)) + shift * y[:, None] * (np.arange(d) < 2), y


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("spread", [2.0, 1e-6])
def test_updates_equal_refits(seed, spread):
    x, y = noisy(seed, 30 + 40 * seed, 3 + 2 * seed)
    assert kernels.left_out(x, y, spread=spread).tolist() == refitted(x, y)


def test_updated_weights_are_the_refitted_ones():
    x, y = noisy(7, 400, 6)
    signs, a = np.where(y == 1, 1.0, -1.0), np.hstack([x, np.ones((400, 1))])
    w = kernels.support_vector(x, signs)
    margin = signs * (a @ w)
    active = margin < 1
    leverage, reach = kernels.reaches(a, margin, np.linalg.inv(np.eye(7) + 2 * a[active].T @ a[active]))
    radius = 2 * reach[active].max()
    near = np.abs(1 - margin) <= leverage * radius
    fixed = active & ~near
    solved = kernels.Solved(w, np.eye(7) + 2 * a[fixed].T @ a[fixed], 2 * a[fixed].T @ signs[fixed], a[near], signs[near], radius)
    places = np.where(near, np.cumsum(near) - 1, -1)
    assert near.sum() < 120
    for i in np.flatnonzero(active)[:60]:
        v, settled = solved.without(a[i], signs[i], int(places[i]))
        assert settled and np.allclose(v, kernels.support_vector(np.delete(x, i, 0), np.delete(signs, i)), atol=1e-7)


def test_rows_near_the_margin_do_not_grow_with_the_subjects():
    counts = []
    for n in (500, 8000):
        x, y = noisy(1, n, 5)
        signs, a = np.where(y == 1, 1.0, -1.0), np.hstack([x, np.ones((n, 1))])
        margin = signs * (a @ kernels.support_vector(x, signs))
        active = margin < 1
        leverage, reach = kernels.reaches(a, margin, np.linalg.inv(np.eye(6) + 2 * a[active].T @ a[active]))
        counts.append(int((np.abs(1 - margin) <= leverage * 2 * reach[active].max()).sum()))
    assert counts[1] < 2 * counts[0]


def test_one_class_alone_and_empty():
    x = np.arange(6.0).reshape(3, 2)
    assert kernels.left_out(x, np.array([1, 1, 1])).tolist() == [1, 1, 1]
    assert kernels.left_out(x, np.array([0, 0, 1])).tolist() == refitted(x, np.array([0, 0, 1]))
    assert kernels.left_out(x[:1], np.array([1])).tolist() == [0] and not len(kernels.left_out(x[:0], np.array([], int)))


@pytest.mark.parametrize(("near_cells", "spread"), [(10**6, 2.0), (0, 2.0), (10**6, 1e-6)])
def test_all_ways_of_partitions_equal_refits(spark, near_cells, spread):
    x, y = noisy(11, 70, 4)
    rows = [("p", f"s{i}", int(y[i]), x[i].tolist()) for i in range(70)] + [("q", f"s{i}", 1, x[i, :2].tolist()) for i in range(3)]
    packed = spark.createDataFrame(rows, "path string, subject string, label int, values array<double>").repartition(5)
    got = {(r.path, r.subject): r.predicted for r in machines.judged(packed, True, near_cells=near_cells, spread=spread).collect()}
    assert got == {("p", f"s{i}"): g for i, g in enumerate(refitted(x, y))} | {("q", f"s{i}"): 1 for i in range(3)}
