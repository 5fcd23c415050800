"""Gram tables beyond the broadcast bound: frequent grams are looked up, the seldom ones alone are joined."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from netweave.llm import lm


@pytest.mark.parametrize("order", [3, 6])
def test_only_seldom_grams_are_joined(spark, monkeypatch, order):
    rows = [(k, "the frequent words of every text are here " * 4 + f"w{k * 7919:x} " * (k % 3)) for k in range(60)] + [(1000, None), (1001, ""), (1010, "Zz qq nothing seen")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r.doc_id: r.score for r in lm.score_documents(docs, order=order).collect()}
    kept, written = [], lm.stored
    monkeypatch.setattr(lm, "stored", lambda df: kept.append(written(df)) or kept[-1])
    monkeypatch.setattr(lm, "BROADCAST_GRAMS", 100)
    found = {r.doc_id: r.score for r in lm.score_documents(docs, order=order).collect()}
    assert found.keys() == want.keys() and all(math.isclose(found[k], want[k], rel_tol=1e-9) for k in want)
    scores, first = (next(df for df in kept if name in df.columns) for name in ("log_p", "grams"))
    joined = first.agg(F.sum(F.size("grams"))).first()[0]
    assert scores.count() > 100 and 0 < joined <= scores.where("n < 20").agg(F.sum(F.greatest("n", F.lit(20)))).first()[0]
    assert joined < 0.3 * sum(len(np.unique(lm.grams(lm.words(t), order))) for _, t in rows)


def test_a_table_knows_which_grams_it_lacks():
    draw = np.random.default_rng(5)
    own = [bytes(draw.integers(97, 101, 5, dtype=np.uint8)) for _ in range(5000)]
    all_grams, times = np.unique(lm.grams(own, 6), return_counts=True)
    held = draw.random(len(all_grams)) < 0.5
    log_p = draw.random(len(all_grams)).astype(np.float32)
    for mask in (held, np.zeros_like(held), np.ones_like(held)):
        total, others, n = lm.DeepTable(*lm.DeepTable.laid_out(all_grams[mask], log_p[mask]), 6).parted(own)
        assert np.isclose(total, (log_p * times)[mask].sum(), rtol=1e-5)
        assert np.array_equal(others, all_grams[~mask]) and np.array_equal(n, times[~mask])
