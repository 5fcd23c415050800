"""A dense random network: its pairs are dealt to tasks, though its nodes come from one file."""

import hashlib

from netweave.operators import networks


def test_pairs_of_one_partition_go_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(networks, "TASK_PAIRS", 100, raising=False)
    nodes = spark.range(60).coalesce(1).withColumnRenamed("id", "node")
    found = networks.random_weights(nodes, 3)
    rows = {(r.src, r.dst): r.weight for r in found.collect()}
    want = {(i, j): int(hashlib.md5(f"{min(i, j)}-{max(i, j)}-3".encode()).hexdigest()[:8], 16) / 4294967296.0 for i in range(60) for j in range(60) if i != j}
    assert rows == want and found.count() == 60 * 59
    assert found.rdd.getNumPartitions() >= 17
    assert networks.random_weights(nodes.limit(0), 3).count() == networks.random_weights(nodes.limit(1), 3).count() == 0
