"""The operators as stages of a pyspark.ml Pipeline; data are matrices in long form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.operators.expression import CentralityExpression, Expression, LinearExpression
from netweave.operators.matrix import standard_scale, validate
from netweave.operators.modules import RATES, find_modules, module_network
from netweave.sources.scratch import stored


class Step(Transformer):
    """Any function of a table."""

    def __init__(self, function: Callable[[DataFrame], DataFrame]) -> None:
        super().__init__()
        self.function = function

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.function(dataset)


def scaling() -> Step:
    return Step(standard_scale)


class ExpressionModel(Model):
    def __init__(self, fitted: Expression) -> None:
        super().__init__()
        self.fitted = fitted

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.fitted.transform(dataset)


class ExpressionEstimator(Estimator):
    def __init__(self, settings: LinearExpression | CentralityExpression) -> None:
        super().__init__()
        self.settings = settings

    def _fit(self, dataset: DataFrame) -> ExpressionModel:
        return ExpressionModel(self.settings.fit(dataset))


class SpectralSettings(Params):
    """How modules are searched; copies of a stage, and maps of settings given to ``fit`` and ``transform``, keep or change them."""

    similarity = Param(Params._dummy(), "similarity", "correlation, heatkernel, zobs, or precomputed for given edges", TypeConverters.toString)
    loo = Param(Params._dummy(), "loo", "whether each subject is left out in turn", TypeConverters.toBoolean)
    fiedler = Param(Params._dummy(), "fiedler", "whether the first cut is by the plain Laplacian", TypeConverters.toBoolean)
    propagate = Param(Params._dummy(), "propagate", "whether that holds for all cuts", TypeConverters.toBoolean)
    bsr = Param(Params._dummy(), "bsr", "precision or recall", TypeConverters.toString)

    def __init__(self, **settings: object) -> None:
        super().__init__()
        self._setDefault(similarity="correlation", loo=False, fiedler=True, propagate=False, bsr="precision")
        self._set(**settings)
        if self.getOrDefault("bsr") not in RATES:
            raise ValueError(f"bsr {self.getOrDefault('bsr')!r} is none of {RATES}")


class SpectralModel(Model, SpectralSettings):
    """The network that ``fit`` has made; data to be judged are (subject, feature, value, label), labels 0 and 1."""

    def __init__(self, edges: DataFrame, **settings: object) -> None:
        super().__init__(**settings)
        self.edges = edges

    def predict(self, dataset: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(leaves(path, node), tree(path, size, bsr, mean_edge, is_leaf)), as of ``find_modules``."""
        get = self.getOrDefault
        return find_modules(validate(dataset), self.edges, get("loo"), get("fiedler"), get("bsr"), get("propagate"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """(path, feature, size, bsr, mean_edge) of the modules that the descent ends in."""
        leaves, tree = self.predict(dataset)
        return leaves.join(tree.where("is_leaf").drop("is_leaf"), "path").select("path", F.col("node").alias("feature"), "size", "bsr", "mean_edge")


class SpectralClustering(Estimator, SpectralSettings):
    """Modules that tell classes apart, as a stage: ``fit`` makes the network of the features, or takes ``edges`` as given.

    Matrices with a null or NaN value, or a cell twice, raise ValueError.
    """

    def __init__(self, edges: DataFrame | None = None, **settings: object) -> None:
        super().__init__(**settings)
        self.edges = edges
        if (self.getOrDefault("similarity") == "precomputed") != (edges is not None):
            raise ValueError("edges are given with the similarity 'precomputed', and only then")

    def _fit(self, dataset: DataFrame) -> SpectralModel:
        edges = self.edges if self.edges is not None else stored(module_network(validate(dataset), self.getOrDefault("similarity")))
        return SpectralModel(edges, **{p.name: v for p, v in self.extractParamMap().items()})
