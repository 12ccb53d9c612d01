"""Searches by place and growing reach give what all edges would give, also where many regions share a place."""

import random

import pytest

from trackweave.operators import graph
from trackweave.plans.queries import _written


def scene(spark, seed=5, copies=6, places=60):
    """Frames of few places with coordinates that tie, each held by several regions."""
    r = random.Random(seed)
    rows = []
    for frame in range(4):
        for _ in range(places):
            x, y = r.choice([r.randrange(40) / 2, r.randrange(4000) / 10]), float(r.randrange(12))
            rows += [(frame, x, y) for _ in range(r.choice([1, 1, copies]))]
    ids = list(range(len(rows)))
    r.shuffle(ids)
    return spark.createDataFrame([(i, *x) for i, x in zip(ids, rows, strict=True)], "region_id bigint, frame int, x double, y double")


def rows_of(df, *columns):
    return sorted((tuple(x) for x in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("side", ["src", "dst"])
def test_nearest_two_equal_the_best_two_of_all_edges(spark, side):
    rows, columns = _written(spark)(scene(spark)), (side, "best", "s1", "second", "s2")
    assert rows_of(graph.nearest_two(rows, _written(spark), side), *columns) == rows_of(graph.best_two(graph.candidate_edges(rows), side), *columns)


def test_only_edges_equal_those_without_rivals(spark):
    rows = scene(spark, places=25)
    want = rows_of(graph.one_to_one(graph.candidate_edges(rows)), "src", "dst", "frame")
    assert want and rows_of(graph.only_edges(rows, _written(spark)), "src", "dst", "frame") == want


def confirmed(edges):
    """One pass in order."""
    out, a, b = [], set(), set()
    for m, s, d in sorted((-round(x["score"], 6), x["src"], x["dst"]) for x in edges):
        if s not in a and d not in b:
            out.append((s, d, -m))
            a.add(s)
            b.add(d)
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1])
def test_confirming_by_reach_equals_one_pass_in_order(spark, seed):
    rows = scene(spark, seed, places=40)
    got = [(s, d, abs(v)) for s, d, v in rows_of(graph.confirm_near(rows, _written(spark)), "src", "dst", "score")]
    assert got == [(s, d, abs(v)) for s, d, v in confirmed(graph.candidate_edges(rows).collect())]


def test_dense_frames_keep_no_edges(spark, tmp_path, monkeypatch):
    """What searches write grows with the regions, not with the pairs of those near each other."""
    rows = scene(spark, copies=60, places=30)
    edges, most, write = graph.candidate_edges(rows).count(), [0], _written(spark)

    def counted(df):
        out = write(df)
        most[0] = max(most[0], out.count())
        return out

    graph.nearest_two(rows, counted).count()
    graph.only_edges(rows, counted).count()
    graph.confirm_near(rows, counted).count()
    assert most[0] <= rows.count() < edges / 10


def test_components_by_place_equal_those_of_all_edges(spark, monkeypatch):
    from trackweave.operators.components import bipartite_components

    rows = scene(spark, places=15)
    want = {(r["frame"], r["src"]): r["component"] for r in bipartite_components(graph.candidate_edges(rows), "src", "dst", _written(spark)).collect()}
    for first in (10.0, 1.25):  # in one step, and with farther pairs that join components
        monkeypatch.setattr(graph, "reaches", lambda *a, first=first: [first, 10.0] if first < 10 else [10.0])
        got = graph.place_components(rows, _written(spark)).filter("side = 0").withColumnRenamed("f", "frame").drop("side")
        assert {(r["frame"], r["region_id"]): r["component"] for r in got.join(rows, ["frame", "x", "y"]).collect()} == want
