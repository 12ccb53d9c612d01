"""Tables of many copies with shifted keys, so that places and spans hold many regions and tracklets: results equal SQL, and what is written stays small."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.oracle import compare
from trackweave.plans import set_queries
from trackweave.plans.queries import _written

COPIES = 12


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    d = tmp_path_factory.mktemp("copies")
    src = "/root/testdata/sf0.001/events.parquet"
    duckdb.sql(f"COPY (SELECT event_id + k * 1000000 AS event_id, ts, user_id + k * (SELECT max(user_id) + 1 FROM '{src}') AS user_id, event_type, value, props FROM '{src}', range({COPIES}) t(k)) TO '{d}/events.parquet'")
    return str(d)


@pytest.fixture(scope="module")
def con(copies):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{copies}/events.parquet'")
    return con


def equal_to_sql(spark, con, copies, name):
    return compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], copies)


def test_excluded_identities_of_copies(spark, con, copies):
    assert not equal_to_sql(spark, con, copies, "excluded_identities")
    spans = _written(spark)(set_queries._spans(spark, copies))
    n = spans.select("start_frame", "end_frame").distinct().count()
    words = spans.agg({"obj_id": "max"}).first()[0] // set_queries.BITS + 1
    assert set_queries._excluded(spans).count() <= n * words < spans.count() * words / 2


def test_identity_sets_of_copies(spark, con, copies):
    assert not equal_to_sql(spark, con, copies, "identity_sets")


def test_inherited_exclusions_of_copies(spark, con, copies):
    assert not equal_to_sql(spark, con, copies, "inherited_exclusions")


def test_conflict_report_of_copies(spark, con, copies):
    assert not equal_to_sql(spark, con, copies, "conflict_report")


def test_symmetric_matchings_make_the_edges_of_small_components_only(spark, copies):
    from trackweave.operators.components import bipartite_components
    from trackweave.plans import rule_queries
    from trackweave.plans.queries import _edges

    rows, places = rule_queries._place_components(spark, copies)
    got = rule_queries._component_edges(rule_queries._component_rows(rows, places)).select("frame", "component", "src", "dst")
    want = bipartite_components(_edges(spark, copies), "src", "dst", _written(spark)).select("frame", "component", "src", "dst")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_dense_paths_of_copies_equal_those_over_all_links(spark, copies):
    from pyspark.sql import functions as F

    from trackweave.operators import graph, intervals
    from trackweave.plans import dense_queries
    from trackweave.sources import tables as S

    write = _written(spark)
    label = write(dense_queries._classes(spark, copies))
    of = lambda k, c: label.filter(F.col("label") == k).select(F.col("tracklet_id").alias(c))
    links = write(set_queries._links(spark, copies).select("a", "b"))
    size = intervals.islands(S.unique_detections(spark, copies)).join(of(1, "tracklet_id"), "tracklet_id").select(F.col("tracklet_id").alias("vertex"), F.col("n").alias("w"))
    best = graph.longest_paths(links.join(of(1, "a"), "a").join(of(1, "b"), "b").select("a", "b"), size, write)
    want = links.join(of(0, "a"), "a").join(best.select(F.col("vertex").alias("b"), "total"), "b").groupBy("a").agg(F.max("total").alias("regions"))
    got = entry.queries()["dense_paths"](spark, copies)
    assert sorted(map(tuple, got.select("tracklet_id", "regions").collect())) == sorted(map(tuple, want.collect()))


def test_arena_links_of_copies_are_the_links_within_an_arena(spark, copies):
    from trackweave.plans import dense_queries

    ends = _written(spark)(set_queries._ends(spark, copies))
    arena = {r["tracklet_id"]: r["obj_id"] // dense_queries.ARENA for r in ends.collect()}
    links = set_queries._links(spark, copies).select("a", "b").collect()
    want = sorted((a, b) for a, b in links if arena[a] == arena[b])
    assert sorted(map(tuple, dense_queries._arena_links(ends).collect())) == want and len(want) < len(links) / 10


def test_neighbour_cardinalities_of_copies(spark, con, copies):
    assert not equal_to_sql(spark, con, copies, "neighbour_cardinalities")


def test_identities_of_copies_are_propagated_by_few_links(spark, copies, monkeypatch):
    from trackweave.plans import identity_queries

    seen, run = [], identity_queries.propagate
    monkeypatch.setattr(identity_queries, "propagate", lambda t, rows, links, write, back: seen.extend([links.count(), back.count()]) or run(t, rows, links, write, back))
    got = sorted(map(tuple, identity_queries._propagated(spark, copies).collect()), key=repr)
    links = set_queries._links(spark, copies)
    assert sum(seen) < links.count() / 10
    monkeypatch.setattr(identity_queries, "propagate", lambda t, rows, some, write, back: run(t, rows, links, write))
    assert got == sorted(map(tuple, identity_queries._propagated(spark, copies).collect()), key=repr)


def test_similar_nodes_of_copies(spark, con, copies):
    assert not equal_to_sql(spark, con, copies, "similar_nodes")
    plan = entry.queries()["similar_nodes"](spark, copies)._jdf.queryExecution().analyzed().toString()
    assert "row_number" in plan  # places of several regions need no search


@pytest.mark.parametrize("name", ["nearest_matches", "mean_errors", "tracklet_cardinalities"])
def test_matches_of_copies(spark, con, copies, name):
    assert not equal_to_sql(spark, con, copies, name)
