"""Modules judged by leaving each subject out: clusters of many cells without a subject near the margin."""

import numpy as np

from netweave.operators import machines, modules


def test_descent_fits_no_subject_anew(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(500, 4)) * 0.05, np.arange(500) % 2
    rows = [(i, f, float(x[i, f]), int(y[i])) for i in range(500) for f in range(4)]
    m = spark.createDataFrame(rows, "subject long, feature long, value double, label int")
    members = spark.createDataFrame([("", f) for f in range(4)] + [("A", 0), ("A", 2)], "path string, node long")
    want = {(r.path, r.subject): r.predicted for r in modules.predictions(m, members, True).collect()}
    opened, anew = [], machines.fitted_anew
    monkeypatch.setattr(machines, "fitted_anew", lambda packed, open_rows, *given: opened.append(open_rows.count()) or anew(packed, open_rows.limit(0), *given))
    assert {(r.path, r.subject): r.predicted for r in modules.predictions(m, members, True, dense_cells=0).collect()} == want
    assert len(want) == 1000 and sum(opened) == 0
