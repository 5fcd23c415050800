"""Components of many nodes: their labels, dealt to salted keys, are many times their files and are never broadcast."""

from netweave.operators import components


def test_many_labels_are_not_broadcast(spark, monkeypatch):
    chain = [(k, k + 1) for k in range(40) if k % 10 != 9]
    edges = spark.createDataFrame(chain + [(b, a) for a, b in chain], "a long, b long")
    plans, written = [], components.stored

    def told(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df)

    monkeypatch.setattr(components, "stored", told)
    monkeypatch.setattr(components, "BROADCAST_LABELS", 20, raising=False)
    want = {k: k // 10 * 10 for k in range(40)}
    assert {r.node: r.component for r in components.component_labels(edges).collect()} == want
    salted = [p for p in plans if "_salt" in p]
    assert salted and all("SortMergeJoin" in p and "BroadcastHashJoin [b" not in p and "BroadcastHashJoin [m" not in p for p in salted)
    plans.clear()
    monkeypatch.setattr(components, "BROADCAST_LABELS", 100)
    assert {r.node: r.component for r in components.component_labels(edges).collect()} == want
