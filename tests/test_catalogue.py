"""Every query with SQL gives the SQL's rows; every other query gives rows."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from netweave.plans import catalogue

SQL = catalogue.oracle_sql()
#: Kernels that SQL cannot express, one of each kind; test_operators.py holds them against numpy.
KERNELS = ["clpe_pagerank_weights", "clpe_large_evec", "cluster_laplace_weight", "linkage_matrix_avg_cut", "cut_tree", "cut_trees", "cluster_centers_pagerank", "dendrogram", "eigengenes", "pca2", "module_report", "random_graph"]


@pytest.fixture(scope="module")
def con(sf_dir):
    own = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        own.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return own


def plain(value):
    return repr(value + 0.0) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(name, spark, sf_dir, con):
    found = catalogue.queries()[name](spark, sf_dir)
    told = con.execute(SQL[name])
    columns = [c[0] for c in told.description]
    assert sorted(columns) == sorted(found.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in found.collect())
    theirs = sorted(tuple(map(plain, r)) for r in told.fetchall())
    assert mine == theirs and mine


@pytest.mark.parametrize("name", KERNELS)
def test_gives_rows(name, spark, sf_dir):
    assert catalogue.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
