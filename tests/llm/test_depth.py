"""The language model's deep levels: against the definitions, and better than the base score on held-out texts."""

import collections
import math
import zlib

import numpy as np
import pytest

from netweave.llm import lm, queries


def tree_scores(rows, order):
    nodes = collections.defaultdict(lambda: [0, 0])
    bits = lambda x: [((1 << j) | (x >> (8 - j)), (x >> (7 - j)) & 1) for j in range(8)]
    raw = {d: b"\n" * order + b" ".join(lm.words(t)) + b"\n" for d, t in rows}
    for d, s in raw.items():
        if zlib.crc32(str(d).encode()) % 10:
            for i in range(order, len(s)):
                for p, bit in bits(s[i]):
                    for k in range(order + 1):
                        nodes[s[i - k : i], p][bit] += 1
    below, own = collections.defaultdict(float), {}
    for c, p in sorted(nodes, key=lambda x: -len(x[0])):
        a, b = nodes[c, p]
        e = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        own[c, p] = 1 if len(c) == order else 1 / (1 + math.exp(min(700, below[c, p] - e)))
        if c:
            below[c[1:], p] += e if len(c) == order else np.logaddexp(e, below[c, p]) - math.log(2)
    out = {}
    for d, s in raw.items():
        out[d] = 0.0
        for i in range(order, len(s)):
            for p, bit in bits(s[i]):
                mix, rest, best = 0.0, 1.0, 0.5
                for k in range(order + 1):
                    if (s[i - k : i], p) not in nodes:
                        break
                    a, b = nodes[s[i - k : i], p]
                    q, share = (b + 0.5) / (a + b + 1), own[s[i - k : i], p]
                    best, mix, rest = mix + rest * q, mix + rest * share * q, rest * (1 - share)
                out[d] += math.log10(best if bit else 1 - best)
    return out


@pytest.mark.parametrize("order, broadcast", [(4, True), (6, True), (6, False)])
def test_deep_levels(spark, sf_dir, monkeypatch, order, broadcast):
    monkeypatch.setattr(lm, "SHARD_GRAMS", 3000)
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(60).collect()
    rows = [(r.doc_id, r.text) for r in texts if len(r.text) < 1500][:25] + [(1000, None), (1001, ""), (1010, "Zz qq\x00 ÿ nothing seen")]
    want = tree_scores(rows, order)
    found = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), broadcast=broadcast, order=order).collect()
    assert len(found) == len(rows) and all(math.isclose(r.score, want[r.doc_id], rel_tol=1e-4) for r in found)


def test_held_out_texts_beat_the_base_score(spark):
    found = queries.op3_language_model(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r.score for r in found) > sum(r.base_score for r in found)


def test_orders(spark, sf_dir):
    with pytest.raises(ValueError):
        lm.score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), order=7)


def test_code_length_of_a_byte(spark):
    rows = [(k, "the same words again " * 5) for k in range(30)] + [(100, None), (101, "zq")]
    for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        size = len(b" ".join(lm.words(dict(rows)[r.doc_id])) + b"\n")
        assert math.isclose(r.bits_per_byte, -r.score * math.log2(10) / size, rel_tol=1e-9)
