"""Subjects that a bound settles without an update: right, and nearly all where there are many."""

import numpy as np
import pytest

from netweave.functions import kernels
from netweave.operators import machines


def drawn(n, d, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) / d**0.5
    return x, (x[:, 0] + 0.5 * rng.normal(size=n) > 0).astype(int)


def counted(monkeypatch):
    calls, without = [], kernels.Solved.without
    monkeypatch.setattr(kernels.Solved, "without", lambda self, *given: calls.append(1) or without(self, *given))
    return calls


@pytest.mark.parametrize("seed", range(4))
def test_settled_rows_are_those_of_refits(seed):
    x, y = drawn(150, 4, seed)
    want = [int(kernels.predict(np.delete(x, i, 0), np.delete(y, i), x[i : i + 1])[0]) for i in range(len(x))]
    assert kernels.left_out(x, y).tolist() == want and kernels.left_out(np.repeat(x, 2, 0), np.repeat(y, 2)).tolist() == [
        int(kernels.predict(np.delete(np.repeat(x, 2, 0), i, 0), np.delete(np.repeat(y, 2), i), np.repeat(x, 2, 0)[i : i + 1])[0]) for i in range(2 * len(x))
    ]


def test_few_of_many_subjects_need_an_update(monkeypatch):
    calls, (x, y) = counted(monkeypatch), drawn(4000, 6)
    found = kernels.left_out(x, y)
    assert len(calls) < 100
    monkeypatch.setattr(kernels.Solved, "stays", lambda self, a, signs, places: np.zeros(len(a), bool))
    assert np.array_equal(found, kernels.left_out(x, y)) and len(calls) > 1000


def test_the_same_over_partitions(spark, monkeypatch):
    x, y = drawn(600, 4)
    rows = [("p", i, int(y[i]), x[i].tolist()) for i in range(600)]
    packed = spark.createDataFrame(rows, "path string, subject long, label int, values array<double>").repartition(3)
    got = {r.subject: r.predicted for r in machines.judged(packed, True).collect()}
    assert got == dict(enumerate(kernels.left_out(x, y).tolist()))


def test_clusters_without_a_subject_near_the_margin_are_not_fitted_anew(spark, monkeypatch):
    x, y = np.random.default_rng(8).normal(size=(900, 3)) * 0.05, np.arange(900) % 2
    a, signs = np.hstack([x, np.ones((900, 1))]), np.where(y == 1, 1.0, -1.0)
    assert np.abs(1 - signs * (a @ kernels.support_vector(x, signs))).min() > 0.3
    rows, opened, anew = [("p", i, int(y[i]), x[i].tolist()) for i in range(900)], [], machines.fitted_anew
    monkeypatch.setattr(machines, "fitted_anew", lambda packed, open_rows, *given: opened.append(open_rows.count()) or anew(packed, open_rows.limit(0), *given))
    packed = spark.createDataFrame(rows, "path string, subject long, label int, values array<double>").repartition(3)
    got = {r.subject: r.predicted for r in machines.judged(packed, True).collect()}
    assert sum(opened) == 0 and got == dict(enumerate(kernels.left_out(x, y).tolist()))
