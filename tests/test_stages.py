"""Spectral modules as a stage of a Pipeline; what it refuses; clusters beyond one task."""

import pytest
from pyspark.ml import Pipeline

from netweave.operators import matrix, modules, networks, stages
from netweave.sources.scratch import stored


@pytest.fixture(scope="module")
def data(spark):
    rows = [(s, f, float(((s * 7 + f * 3) % 11) + (4 if f < 3 and s % 2 else 0)), s % 2) for s in range(24) for f in range(8)]
    return spark.createDataFrame(rows, "subject long, feature long, value double, label int")


def rows(df):
    return sorted(map(str, df.collect()))


def test_a_pipeline_gives_the_operators_modules(data):
    model = Pipeline(stages=[stages.scaling(), stages.SpectralClustering(similarity="correlation", bsr="recall")]).fit(data)
    scaled = matrix.standard_scale(data)
    leaves, tree = modules.find_modules(scaled, stored(networks.correlation(scaled)), bsr="recall")
    found = model.transform(data)
    assert found.columns == ["path", "feature", "size", "bsr", "mean_edge"]
    assert sorted((r.path, r.feature) for r in found.collect()) == sorted((r.path, r.node) for r in leaves.collect())
    assert {r.path: r.bsr for r in found.collect()} == {r.path: r.bsr for r in tree.where("is_leaf").collect()}


def test_settings_copies_and_refusals(spark, data):
    stage = stages.SpectralClustering(similarity="zobs", loo=True)
    other = stage.copy({stage.loo: False})
    assert stage.getOrDefault("loo") and not other.getOrDefault("loo") and other.getOrDefault("similarity") == "zobs"
    given = stages.SpectralClustering(networks.correlation(data), similarity="precomputed").fit(data)
    assert given.predict(data)[1].count() > 0
    with pytest.raises(ValueError):
        stages.SpectralClustering(similarity="precomputed")
    with pytest.raises(ValueError):
        stages.SpectralClustering(bsr="f1")
    bad = data.limit(3).union(spark.createDataFrame([(99, 0, float("nan"), 0)], data.schema))
    for odd in (bad, data.union(data.limit(1))):
        with pytest.raises(ValueError):
            stages.SpectralClustering().fit(odd)


def test_modules_of_networks_beyond_one_task(data):
    edges = stored(networks.correlation(data))
    small, large = (modules.find_modules(data, edges, dense_nodes=limit) for limit in (4096, 5))
    assert rows(small[0]) == rows(large[0]) and rows(small[1]) == rows(large[1])
