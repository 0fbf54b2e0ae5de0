"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
#: One of each family; the driver compares all of them.
CHOSEN = ["knn_graph", "bipartite_knn", "flowrank", "recursive_majority", "layer_ntile", "densify_rw_edges", "heat_kernel_weights", "fine_grained_vote", "anchor_pulls", "diffusion_snapshots", "cutoffs", "rw_visits"]


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    got = entry.queries()[name](spark, SF).toPandas()
    want = db.execute(entry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(want)
    a, b = (t[columns].sort_values(columns).reset_index(drop=True) for t in (got, want))
    assert a.astype(b.dtypes).equals(b)


def test_every_query_has_a_callable_and_sql_names_exist():
    queries = entry.queries()
    assert all(callable(q) for q in queries.values()) and set(entry.oracle_sql()) <= set(queries)


def test_entry(spark):
    assert entry.entry(spark).count() == 100


def test_walks_start_from_the_whole_core(spark):
    queries = entry.queries()
    core = {r.id for r in queries["flowrank"](spark, SF).orderBy("score", ascending=False).limit(300).collect()}
    out = {}
    for r in queries["knn_graph"](spark, SF).collect():
        out.setdefault(r.src, []).append(r.dst)

    found = {}
    for seed in core:
        now = {seed: 1.0}
        for _ in range(5):
            moved = {}
            for node, p in now.items():
                if round(p, 12) > 1e-4:
                    for dst in out[node]:
                        moved[dst] = moved.get(dst, 0) + p / len(out[node])
            now = moved
            for node, p in now.items():
                found[seed, node] = found.get((seed, node), 0) + p
    visits = {(r.seed, r.node): r.visits for r in queries["rw_visits"](spark, SF).collect()}
    assert visits.keys() == found.keys() and all(abs(found[k] - v) < 1e-9 for k, v in visits.items())
    assert {k[0] for k in visits} == core
    assert {r.seed for r in queries["top_per_row"](spark, SF).select("seed").distinct().collect()} == core


def test_approximate_neighbours_are_mostly_exact(spark):
    assert entry.queries()["knn_lsh_recall"](spark, SF).first().recall >= 0.9
