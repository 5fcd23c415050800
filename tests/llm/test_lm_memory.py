"""Memory of the language model's tasks, as a multiple of what they hold."""

import tracemalloc

import numpy as np
import pandas as pd

from netweave.llm import lm


def peak(run) -> int:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def random_grams(size: int, seed: int) -> np.ndarray:
    return np.unique(np.random.default_rng(seed).integers(0, 1 << 52, size))


def test_the_table_is_laid_out_in_steps():
    mixed, log_p = lm.DeepTable.laid_out(random_grams(2_000_000, 1), np.zeros(2_000_000, np.float32))
    assert peak(lambda: lm.DeepTable(mixed, log_p, 6)) < 14 * len(mixed)  # 4 bytes a range, and a step's


def test_nodes_below_the_middle_are_let_go():
    keys = random_grams(100_000, 2)
    whole = peak(lambda: lm.Subtrees(keys, np.ones(len(keys), np.int64), 6))
    top = peak(lambda: lm.Subtrees(keys, np.ones(len(keys), np.int64), 6, whole=False))
    assert top < 0.7 * whole
    found = [lm.Subtrees(keys, np.ones(len(keys), np.int64), 6, whole=w).top() for w in (True, False)]
    pd.testing.assert_frame_equal(*found)


def test_a_long_text_is_looked_up_in_steps():
    draw = np.random.default_rng(3)
    own = [bytes(draw.integers(97, 123, 9, dtype=np.uint8)) for _ in range(300_000)]
    keys = np.unique(lm.grams(own, 6))
    assert np.array_equal(np.concatenate(list(lm.grams_in_steps(own, 6))), lm.grams(own, 6))
    mixed, log_p = lm.DeepTable.laid_out(keys, draw.random(len(keys), np.float32))
    table = lm.DeepTable(mixed, log_p, 6)
    scores = dict(zip(mixed.tolist(), log_p.tolist(), strict=True))
    assert np.isclose(table.score(own), sum(scores[x] for x in (lm.grams(own, 6).astype(np.uint64) * table.FACTOR).tolist()))
    assert peak(lambda: table.score(own)) < 16 * len(b" ".join(own))


def test_counts_come_in_small_frames(spark, monkeypatch):
    monkeypatch.setattr(lm, "FLUSH_GRAMS", 20_000)
    monkeypatch.setattr(lm, "HANDED", 5_000)
    rows = [(k, " ".join(f"{k}x{j * 7919 % 104729}" for j in range(2500))) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text", "doc_id % 3 = 0 as held_out")
    found = {r.gram: r.n for r in lm.count_grams(docs, 6).collect()}
    want: dict[int, int] = {}
    for k, text in rows:
        for g in lm.grams(lm.words(text), 6).tolist():
            want[g] = want.get(g, 0) + (k % 3 != 0)
    assert found == want
