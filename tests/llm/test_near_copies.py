"""Near copies are tested against one of them, not against each other."""

import random

from netweave.llm import ngram_join


def test_each_near_copy_moves_about_once(spark, monkeypatch):
    draw, rows, size = random.Random(5), [], 12
    for group in range(2):
        base = [f"w{draw.randrange(10**6)}" for _ in range(200)]
        for k in range(size):
            own = list(base)
            own[10 + 15 * k] = f"x{group}y{k}"
            rows.append((100 * group + k, " ".join(own)))
    tested, plain = [], ngram_join.verified

    def counted(pairs, sets):
        tested.append(pairs.count())
        return plain(pairs, sets)

    monkeypatch.setattr(ngram_join, "verified", counted)
    found = {r.doc_id: r.component_id for r in ngram_join.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {d: d // 100 * 100 for d, _ in rows}
    assert 0 < sum(tested) <= 2 * len(rows)  # 132 pairs are near


def test_ids_are_broadcast_only_within_the_bound(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 1)
    base = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join([*base[:60], f"x{k}", *base[61:]])) for k in range(4)] + [(9, "none of those"), (10, None)]
    found = {r.doc_id: r.component_id for r in ngram_join.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 0, 9: 9, 10: 10}
