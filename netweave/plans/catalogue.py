"""The registered query of every operator, over the whole tables. Values are rounded to six places to compare."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.operators import centrality, expression, hierarchy, modules, networks, plotdata, spectral, stages
from netweave.operators import matrix as matrices
from netweave.plans import inputs
from netweave.plans.oracles import SET, oracles
from netweave.sources.groups import membership

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[(F.round(c, 6) + 0.0).alias(c) if c in columns else c for c in df.columns])


def on_matrix(name: str, build: Callable[[DataFrame], DataFrame], *columns: str) -> None:
    """Register a query that needs the embeddings' matrix alone."""
    QUERIES[name] = lambda spark, sf_dir: rounded(build(inputs.matrix(spark, sf_dir)), *columns)


def linear(m: DataFrame, normalize: bool = True) -> expression.Expression:
    return expression.LinearExpression(inputs.members(m), inputs.features(m), normalize).fit()


def central(m: DataFrame, **settings) -> expression.Expression:
    return expression.CentralityExpression(inputs.members(m), inputs.features(m), edges=inputs.coded_edges(m), **settings).fit(m)


def given_weights(m: DataFrame) -> DataFrame:
    return inputs.members(m).withColumn("weight", ((F.col("feature") * 7 + F.col("pathway")) % 5).cast("double"))


def lpe_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal-weight group expression of every subject: the flagship."""
    m = inputs.matrix(spark, sf_dir)
    return rounded(linear(m).transform(m), "value")


QUERIES["lpe_expression"] = lpe_expression
on_matrix("lpe_unnormalized", lambda m: linear(m, False).transform(m), "value")
on_matrix("glpe_transform_precomputed", lambda m: expression.Expression(given_weights(m), inputs.members(m)).transform(m), "value")
on_matrix("standard_scale", lambda m: matrices.standard_scale(m).drop("label"), "value")
on_matrix("corr_adjacency", networks.correlation, "weight")
on_matrix("corr_signed", lambda m: networks.correlation(m, negative=True), "weight")
on_matrix("corr_centred", lambda m: networks.correlation(m, center=True), "weight")
on_matrix("corr_epsilon", lambda m: networks.correlation(m, epsilon=0.05), "weight")
on_matrix("heatkernel_adjacency", lambda m: networks.adjacency(m, "heatkernel", parameter=500), "weight")
on_matrix("heatkernel_l1", lambda m: networks.heat_kernel(m, parameter=200000, order=1), "weight")
QUERIES["zobs_adjacency"] = lambda spark, sf_dir: rounded(networks.fisher_difference(inputs.two_classes(spark, sf_dir)), "weight")
on_matrix("tom_similarity", lambda m: networks.topological_overlap(networks.correlation(m)), "weight")
on_matrix("sim2dist", lambda m: networks.similarity_to_distance(networks.correlation(m)), "weight")
on_matrix("coded_edges_directed", lambda m: networks.coded_network(inputs.coded_edges(m)))
on_matrix("coded_edges_undirected", lambda m: networks.coded_network(inputs.coded_edges(m), directed=False))
on_matrix("clpe_degree_weights", lambda m: central(m).weights, "weight")
on_matrix("clpe_degree_undirected", lambda m: central(m, directed=False).weights, "weight")
on_matrix("clpe_degree_expression", lambda m: central(m).transform(m), "value")
on_matrix("clpe_correlation_weights", lambda m: central(m, network="correlation").weights, "weight")
on_matrix("clpe_heatkernel_weights", lambda m: central(m, network="heatkernel", heat_kernel_parameter=500).weights, "weight")
on_matrix("clpe_pagerank_weights", lambda m: central(m, centrality="page_rank").weights, "weight")
on_matrix("clpe_large_evec", lambda m: central(m, centrality="large_evec", network="correlation").weights, "weight")
on_matrix("restrict_features", lambda m: matrices.restrict(m.drop("label"), inputs.members(m).where("pathway = 7")), "value")


@query
def pathway_membership_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market segments as groups of the traits that any of their customers have; all pairs, with whether they are kept."""
    customer = inputs.read(spark, sf_dir, "customer")
    high, low, even = F.col("c_acctbal") > 9000, F.col("c_acctbal") < -900, F.col("c_nationkey") % 2 == 0
    traits = {"acct_high": high, "acct_low": low, "nation_even": even, "nation_odd": ~even}
    wide = customer.groupBy(F.col("c_mktsegment").alias("pathway")).agg(*[F.count_if(x).cast("double").alias(n) for n, x in traits.items()])
    kept = membership(wide).withColumn("kept", F.lit(True))
    grid = wide.select("pathway", F.explode(F.array(*map(F.lit, traits))).alias("feature"))
    return grid.join(kept, ["pathway", "feature"], "left").select("pathway", "feature", F.coalesce("kept", F.lit(False)).alias("kept"))


@query
def metadata_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = inputs.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject"), F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment")
    nation = inputs.read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    return matrices.with_metadata(customer, nation, "n_nationkey").select("subject", "nation", matrices.is_case(F.col("c_mktsegment"), "BUILDING").alias("is_case"))


@query
def degree_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(centrality.degree(inputs.flow(spark, sf_dir), inputs.flow_nodes(spark, sf_dir)), "score")


@query
def pagerank_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(centrality.page_rank(inputs.flow(spark, sf_dir), inputs.flow_nodes(spark, sf_dir)), "score")


@query
def pagerank_in_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(centrality.page_rank(inputs.flow(spark, sf_dir), inputs.flow_nodes(spark, sf_dir), in_rank=True), "score")


@query
def pagerank_stochastic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(centrality.page_rank(inputs.flow(spark, sf_dir), inputs.flow_nodes(spark, sf_dir), stochastic=True), "score")


@query
def eigenvector_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = inputs.matrix(spark, sf_dir)
    return rounded(centrality.leading_eigenvector(spectral.stored(networks.correlation(m)), inputs.nodes(m)), "score")


@query
def pathway_centrality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = inputs.matrix(spark, sf_dir)
    return rounded(central(m).centrality_scores(inputs.features(m).where(F.col("feature").isin(*SET))), "score")


@query
def simple_transform_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = inputs.matrix(spark, sf_dir)
    return rounded(linear(m).rank(inputs.features(m), list(SET), 20), "score", "p_val")


@query
def supra_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(networks.supra_adjacency(inputs.layers(spark, sf_dir), "correlation"), "weight")


@query
def supra_heatkernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(networks.supra_adjacency(inputs.layers(spark, sf_dir), "heatkernel", parameter=1e6), "weight")


@query
def supra_scores_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = inputs.layers(spark, sf_dir)
    nodes = layers.select("t", F.col("feature").alias("node")).distinct()
    return rounded(centrality.layer_scores(centrality.supra_degree(networks.supra_adjacency(layers, "correlation"), nodes)), "score")


@query
def supra_scores_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = inputs.layers(spark, sf_dir)
    nodes = layers.select("t", F.col("feature").alias("node")).distinct()
    return rounded(centrality.supra_scores(spectral.stored(networks.supra_adjacency(layers, "correlation")), nodes, "page_rank"), "score")


@query
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centrality.connected_components(inputs.trade(spark, sf_dir), inputs.trade_nodes(spark, sf_dir))
    return found.groupBy("component").agg(F.count("*").alias("nodes"))


def fifths(m: DataFrame) -> DataFrame:
    return inputs.nodes(m).select("node", (F.col("node") % 5).alias("cluster"))


on_matrix("cluster_centers", lambda m: centrality.cluster_centers(networks.correlation(m), fifths(m))[0])
on_matrix("cluster_center_edges", lambda m: centrality.cluster_centers(networks.correlation(m), fifths(m))[1], "weight")
on_matrix("graph_display_edges", lambda m: plotdata.display_edges(networks.correlation(m), inputs.nodes(m)))


@query
def graph_display_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(plotdata.display_nodes(inputs.flow(spark, sf_dir), inputs.flow_nodes(spark, sf_dir)).select("node", "size"), "size")


@query
def er_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return networks.hashed_graph(inputs.suppliers(spark, sf_dir), 60)


@query
def svm_rates_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of a given prediction."""
    given = inputs.read(spark, sf_dir, "embeddings").select(F.lit("").alias("path"), (F.col("label") % 3).alias("label"), (F.col("vec_id") % 3).alias("predicted"))
    return rounded(modules.rates(given).select("bsr"), "bsr")


def rows_only(name: str, build: Callable[[DataFrame], DataFrame], *columns: str, classes: bool = False) -> None:
    """Register a query whose kernel SQL cannot express."""
    source = inputs.two_classes if classes else inputs.matrix
    QUERIES[name] = lambda spark, sf_dir: rounded(build(source(spark, sf_dir)), *columns)


def hierarchy_of(m: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(network, its full hierarchy of clusters)."""
    edges = spectral.stored(networks.correlation(m))
    return edges, spectral.cluster_laplace(edges, inputs.nodes(m)).select("path", "node")


def scaled(m: DataFrame) -> DataFrame:
    return matrices.standard_scale(m)


def bare_rates(m: DataFrame, loo: bool) -> DataFrame:
    return modules.rates(modules.predictions(m, spectral.whole(inputs.nodes(m)), loo))


def module_tree(m: DataFrame, similarity: str, loo: bool = False) -> DataFrame:
    return modules.find_modules(m, spectral.stored(modules.module_network(m, similarity)), loo)[1]


rows_only("laplace_partition", lambda m: spectral.laplace_partition(networks.correlation(m), inputs.nodes(m)), "value")
rows_only("laplace_partition_normalized", lambda m: spectral.laplace_partition(networks.correlation(m), inputs.nodes(m), fiedler=False), "value")
rows_only("cluster_laplace_size", lambda m: spectral.cluster_laplace(networks.correlation(m), inputs.nodes(m), min_size=4))
rows_only("cluster_laplace_weight", lambda m: spectral.cluster_laplace(networks.correlation(m), inputs.nodes(m), min_size=4, stop="weight"))
rows_only("spectrum", lambda m: spectral.spectrum(networks.correlation(m), inputs.nodes(m)), "eigenvalue")
rows_only("graph_embedding", lambda m: spectral.embedding(networks.correlation(m), inputs.nodes(m)), "x", "y")
rows_only("linkage_matrix_dumb", lambda m: hierarchy.cluster_linkage(hierarchy_of(m)[1]))
rows_only("linkage_matrix_avg_cut", lambda m: (lambda e, c: hierarchy.cluster_linkage(c, e, "avg_cut"))(*hierarchy_of(m)), "height")
rows_only("subset_parents", lambda m: hierarchy.subset_parents(hierarchy_of(m)[1]))
rows_only("wgcna_linkage", lambda m: hierarchy.overlap_linkage(m)[1], "height")
rows_only("cut_tree", lambda m: hierarchy.cut_tree(hierarchy.overlap_linkage(m)[1], n_clusters=6))
rows_only("cut_trees", lambda m: hierarchy.cut_trees(hierarchy.overlap_linkage(m)[1], [2, 6], [0.9]))
rows_only("cluster_centers_pagerank", lambda m: centrality.cluster_centers(networks.correlation(m), fifths(m), "page_rank")[0])
rows_only("graph_layout_spectral", lambda m: plotdata.display_layout(networks.correlation(m), inputs.nodes(m), "spectral"), "size", "x", "y")
rows_only("graph_layout_spring", lambda m: plotdata.display_layout(networks.correlation(m), inputs.nodes(m), "spring"), "size", "x", "y")
rows_only("dendrogram", lambda m: (lambda e, c: plotdata.dendrogram(c, e, m.drop("label"))[2])(*hierarchy_of(m)), "value")
rows_only("dendrogram_order", lambda m: hierarchy.dendrogram_order(hierarchy.overlap_linkage(m)[1]))
rows_only("dendrogram_heat_map", lambda m: plotdata.heat_map(networks.correlation(m), hierarchy.dendrogram_order(hierarchy.overlap_linkage(m)[1])), "value")
rows_only("eigengenes", lambda m: hierarchy.eigengenes(m, hierarchy.cut_tree(hierarchy.overlap_linkage(m)[1], n_clusters=6).select(F.col("item").alias("feature"), "cluster")), "value")
rows_only("module_reps_linkage", lambda m: hierarchy.module_representatives(networks.correlation(m), inputs.nodes(m), 0.9)[0], "height")
rows_only("module_reps_labels", lambda m: hierarchy.module_representatives(networks.correlation(m), inputs.nodes(m), 0.9)[1])
rows_only("pca2", lambda m: plotdata.principal_components(scaled(m))[0], "score")
rows_only("pca2_ratio", lambda m: plotdata.principal_components(scaled(m))[1], "ratio")
rows_only("svm_bsr_insample", lambda m: bare_rates(m, False), "bsr", classes=True)
rows_only("svm_bsr_loo", lambda m: bare_rates(m, True), "bsr", classes=True)
rows_only("spectral_modules_insample", lambda m: module_tree(m, "correlation"), "bsr", classes=True)
rows_only("spectral_modules_loo", lambda m: module_tree(m, "correlation", True), "bsr", classes=True)
rows_only("spectral_modules_zobs", lambda m: module_tree(m, "zobs"), "bsr", classes=True)
rows_only("spectral_pipeline", lambda m: Pipeline(stages=[stages.scaling(), stages.SpectralClustering(similarity="correlation")]).fit(m).transform(m), "bsr", classes=True)
rows_only("module_report", lambda m: modules.report(module_tree(m, "zobs"), m), classes=True)


def given_linkage(m: DataFrame) -> DataFrame:
    return hierarchy.cluster_linkage(inputs.given_clusters(m), networks.correlation(m), "avg_cut")


on_matrix("subset_parents_given", lambda m: hierarchy.subset_parents(inputs.given_clusters(m)))
on_matrix("linkage_dumb_given", lambda m: hierarchy.cluster_linkage(inputs.given_clusters(m)), "height")
on_matrix("linkage_avg_cut_given", given_linkage, "height")
on_matrix("cut_tree_given", lambda m: hierarchy.cut_tree(spectral.stored(given_linkage(m)), height=11))
on_matrix("cut_trees_given", lambda m: hierarchy.cut_trees(given_linkage(m), [2, 6], [11]))
on_matrix("dendrogram_order_given", lambda m: hierarchy.dendrogram_order(given_linkage(m)))


@query
def random_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense network of all suppliers."""
    return networks.mirrored(rounded(networks.random_pairs(inputs.suppliers(spark, sf_dir), seed=1), "weight"))  # a pair is rounded once


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in oracles().items() if name in QUERIES}
