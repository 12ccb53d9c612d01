from itertools import permutations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.functions import geometry as G
from trackweave.operators import graph, intervals, kernels
from trackweave.sources import tables as S
from trackweave.streaming.tracklets import session_tracklets


def test_assignment_equals_brute_force():
    rng = np.random.default_rng(0)
    for n, m in product((1, 2, 3, 4), (1, 3, 5)):
        c = rng.integers(0, 20, (n, m)).astype(float)
        small, large = (c, m) if n <= m else (c.T, n)
        best = min(sum(small[i, p[i]] for i in range(len(small))) for p in permutations(range(large), len(small)))
        assert sum(c[i, j] for i, j in kernels.assignment(c)) == best
    assert kernels.assignment(np.empty((0, 3))) == []


def test_angle_values(spark):
    full = [(10, 20, 10), (10, 180, 170), (0, 190, 170), (0, 270, 90), (90, 270, 180), (-10, 10, 20), (80, 280, 160), (0, -10, 10), (0, 360, 0), (10, 300, 70)]
    axis = [(10, 180, 10), (0, 190, 10), (90, 270, 0), (80, 280, 20), (-30, 300, 30)]
    for rows, f in ((full, G.angle_error), (axis, G.axis_angle_error)):
        df = spark.createDataFrame(rows, "a int, b int, want int")
        assert df.filter(f(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_boxes_touch_at_corners(spark):
    df = spark.createDataFrame([(0, 0, 10, 10, 10, 10, 1, 1, True), (5, 5, 1, 1, 10, 10, 1, 1, False)], "a int, b int, c int, d int, e int, f int, g int, h int, want boolean")
    assert df.filter(G.boxes_touch(*[F.col(c) for c in "abcdefgh"]) != F.col("want")).count() == 0


def test_overlap_join_equals_nested_loops(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(s), int(s + n)) for i, (s, n) in enumerate(zip(rng.integers(0, 90, 60), rng.integers(0, 40, 60), strict=True))]
    t = spark.createDataFrame(rows, "tracklet_id int, start_frame int, end_frame int")
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[1] <= b[2] and b[1] <= a[2])
    got = [(r["tracklet_id"], r["tracklet_id2"]) for r in intervals.overlap_join(t, t, bucket=7).collect()]
    assert sorted(got) == want


def test_greedy_confirmation_equals_one_pass(spark, tmp_path):
    rng = np.random.default_rng(2)
    edges = sorted({(int(a), int(b)) for a, b in rng.integers(0, 15, (80, 2))})
    rows = [(a, b + 100, float(rng.integers(1, 9))) for a, b in edges]
    used, want = set(), []
    for a, b, s in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if a not in used and b not in used:
            used |= {a, b}
            want.append((a, b, s))
    df = spark.createDataFrame(rows, "src int, dst int, score double")
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    got = graph.confirm_greedily(df, lambda x: x.checkpoint()).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_paths_are_contracted(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    df = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51)], "src int, dst int")
    got = {r["vertex"]: (r["head"], r["hops"]) for r in graph.contract_paths(df, lambda x: x.checkpoint()).collect()}
    assert got == {i: (0, i) for i in range(21)} | {50: (50, 0), 51: (50, 1)}


def _merged_by_brute_force(v, most):
    groups = [[i] for i in range(len(v))]
    dist = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    while len(groups) > most:
        _, i, j = min((dist[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        groups[i] = sorted(groups[i] + groups.pop(j))
    return groups


def test_prototypes_equal_brute_force():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 6, 17, 40):
        v = rng.normal(size=(n, 4))
        got, want = kernels.prototypes(v), _merged_by_brute_force(v, 5)
        assert [w for _, w, _ in got] == [len(g) for g in want]
        assert all(np.allclose(m, v[g].mean(0)) and np.isclose(s, np.sqrt(((v - v[g].mean(0)) ** 2).sum(1)).mean()) for (m, _, s), g in zip(got, want, strict=True))


def test_prototypes_hold_every_vector(spark, tmp_path):
    from trackweave.plans.queries import QUERIES

    rng = np.random.default_rng(4)
    v = rng.normal(size=(90, 3)).round(3)
    spark.createDataFrame([(i, 1, x.tolist()) for i, x in enumerate(v)], "vec_id int, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["descriptor_prototypes"](spark, str(tmp_path)).orderBy("proto_id").collect()
    want = _merged_by_brute_force(v.astype("float32").astype(float), 5)
    assert sum(r["weight"] for r in got) == 90 and [r["weight"] for r in got] == [len(g) for g in want]
    assert all(np.allclose(r["descriptor"], v[g].mean(0), atol=1e-5) for r, g in zip(got, want, strict=True))


def test_cardinalities_fill_each_set():
    areas = {1: 110.0, 2: 85.0, 3: 400.0, 4: 180.0}
    got = kernels.cardinalities([[1, 2, 3], [3, 4]], areas, 2, 100.0)
    sets, cost = [[1, 2, 3], [3, 4]], lambda k: sum(abs(areas[t] - k[t] * 100) for t in k)
    every = [dict(zip(areas, k, strict=True)) for k in product(range(3), repeat=4)]
    assert cost(got) == min(cost(k) for k in every if all(sum(k[t] for t in s) == 2 for s in sets))


def test_headings_follow_the_movement():
    x, y = np.arange(0, 80, 10.0), np.zeros(8)
    theta = np.where(np.arange(8) % 2, np.pi, 0.0)
    assert np.allclose(np.cos(kernels.orient(x, y, theta, np.full(8, 4.0))), 1)


def test_mot_counts():
    truth = [(t, {1: (0.0, t), 2: (9.0, t)}, {7: (0.0, t), 8: (9.0, t)} if t < 3 else {8: (0.0, t), 7: (9.0, t)}) for t in range(5)]
    got = kernels.clear_mot(truth, 2.0)
    assert (got["num_matches"], got["num_switches"], got["num_misses"], got["mota"]) == (8, 2, 0, 0.8)
    assert kernels.clear_mot([(0, {1: (0, 0)}, {}), (1, {}, {3: (0, 0)})], 1.0)["mota"] == -1


def _mot_tables(spark, monkeypatch, frames):
    truth = [(t, i, float(x), float(y)) for t, a, _ in frames for i, (x, y) in a.items()]
    found = [(t, i, float(x), float(y)) for t, _, b in frames for i, (x, y) in b.items()]
    kind = "frame int, id int, x double, y double"
    monkeypatch.setattr(S, "ground_truth", lambda spark, d: spark.createDataFrame(truth, kind))
    monkeypatch.setattr(S, "predictions", lambda spark, d: spark.createDataFrame(found, kind))


def test_mot_is_one_sequence(spark, monkeypatch):
    from trackweave.plans.queries import QUERIES

    rng, frames = np.random.default_rng(5), []
    for t in range(100):
        a = {i: (20.0 * i, t / 9) for i in range(6) if rng.random() < 0.9}
        shift = 30 <= t < 61  # ids change at the edge of a block of 30 frames
        frames.append((t, a, {(i + 1) % 6 if shift else i: (x + 1, y) for i, (x, y) in a.items() if rng.random() < (0.9 if i else 0.1)} | {50: (900, 900)}))
    _mot_tables(spark, monkeypatch, frames)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # frames go over batches
    got = QUERIES["clear_mot"](spark, "").collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = kernels.clear_mot(frames, 5.0)
    assert len(got) == 1 and want["num_switches"] > 0 and want["num_fragmentations"] > 0
    assert got[0].asDict().keys() == want.keys() and all(np.isclose(got[0][k], v) for k, v in want.items())


def test_a_prediction_has_one_object_in_a_frame():
    frames = [(0, {1: (0, 0)}, {5: (0, 0)}), (1, {2: (0, 0)}, {5: (0, 0)}), (2, {1: (0, 0), 2: (0, 0)}, {5: (0, 0)})]
    got = kernels.clear_mot(frames, 1.0)
    assert (got["num_detections"], got["num_misses"], got["num_false_positives"]) == (3, 1, 0)


def test_permuted_identities_score_full(spark, monkeypatch):
    from trackweave.plans.queries import QUERIES

    frames = [(t, {i: (20 * i, t) for i in range(5)}, {(i + 2) % 5: (20 * i + 1, t) for i in range(5)}) for t in range(70)]
    _mot_tables(spark, monkeypatch, frames)
    assert sorted(map(tuple, QUERIES["identity_assignment"](spark, "").collect())) == [(i, (i + 2) % 5, 70) for i in range(5)]
    r = QUERIES["identity_scores"](spark, "").first()
    assert (r["n_gt"], r["n_pred"], r["idtp"], r["idf1"]) == (350, 350, 350, 1.0)


def test_best_pairs_equal_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(30):
        m = rng.integers(0, 6, (4, 5)) * (rng.random((4, 5)) < 0.5)
        r, c = np.nonzero(m)
        got = kernels.best_pairs(r.tolist(), c.tolist(), m[r, c].tolist())
        assert sum(n for _, _, n in got) == max(sum(m[i, p[i]] for i in range(4)) for p in permutations(range(5), 4))
        assert all(m[i, j] == n > 0 for i, j, n in got)


def test_mot_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 2.5, 3.0), (1, 2, None, None)], "frame int, id int, x double, y double")
    S.write_mot(rows, f"{tmp_path}/mot")
    assert sorted(map(tuple, S.read_mot(spark, f"{tmp_path}/mot").select("frame", "id", "x", "y").collect()), key=str) == [(1, 1, 2.5, 3.0), (1, 2, None, None)]


def test_projects_have_optional_tables(spark, tmp_path):
    S.save_project({"regions": spark.range(3)}, str(tmp_path))
    got = S.load_project(spark, str(tmp_path), ["regions"], {"tracks": "id bigint"})
    assert got["regions"].count() == 3 and got["tracks"].count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        S.load_project(spark, str(tmp_path), ["missing"])


def test_a_stream_closes_the_same_tracklets(spark, tmp_path):
    rows = spark.range(40).selectExpr("id % 2 AS k", "timestamp_seconds(id * 10 + CASE WHEN id > 20 THEN 3600 ELSE 0 END) AS ts")
    rows.write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([(9,)], "k bigint").selectExpr("k", "timestamp_seconds(900000) AS ts").write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k bigint, ts timestamp").parquet(f"{tmp_path}/in")
    q = session_tracklets(stream, "k", "ts", "10 minutes", late="1 minute").writeStream.outputMode("append").format("memory").queryName("closed").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    want = session_tracklets(rows, "k", "ts", "10 minutes")
    assert sorted(map(tuple, spark.table("closed").collect())) == sorted(map(tuple, want.collect()))


def _with_sql():
    import __spark_entry__ as e

    return [n for n in e.oracle_sql() if not n.startswith("op") and n != "pipeline"]


@pytest.mark.parametrize("name", _with_sql())
def test_queries_equal_sql(spark, name):
    import __spark_entry__ as e
    from tests.oracle import compare

    assert compare(spark, _duck(), name, e.queries()[name], e.oracle_sql()[name], "/root/testdata/sf0.001") == ""


def _duck(d="/root/testdata/sf0.001"):
    import duckdb

    from tests.oracle import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return con


def test_a_grid_can_take_steps(spark):
    from trackweave.plans.queries import QUERIES

    d = "/root/testdata/sf0.001"
    whole, part = ({tuple(r) for r in QUERIES["trajectory_grid"](spark, d, step=step).collect()} for step in (1, 5))
    assert part == {r for r in whole if r[0] % 5 == 0}
    assert {r["frame"] for r in QUERIES["tracklets_in_frame"](spark, d).select("frame").distinct().collect()} == {r[0] for r in whole}


def _paths(spark):
    rng, rows = np.random.default_rng(7), []
    for i in range(25):
        at = int(rng.integers(0, 40))
        for k in range(int(rng.integers(1, 12))):
            rows.append((100 - i, at + k, k, float(rng.integers(0, 9)), float(rng.integers(0, 9))))
    return rows, spark.createDataFrame([*rows, (500, 900, 0, 0.0, 0.0)], "tracklet_id int, frame int, pos int, x double, y double")


def test_overlaps_of_any_length_equal_brute_force(spark):
    rows, df = _paths(spark)
    held = {}
    for t, f, *_ in rows:
        held.setdefault(t, set()).add(f)
    want = {t: [u for u in held if u != t and held[t] & held[u]] for t in held}
    got = {r["tracklet_id"]: (r["n"], r["lo"], r["hi"]) for r in intervals.overlap_summary(df).collect()}
    assert got == {t: (len(u), min(u), max(u)) for t, u in want.items() if u}


def test_distances_of_any_two_paths(spark):
    rows, df = _paths(spark)
    at = {}
    for t, f, _, x, y in rows:
        at.setdefault(t, {})[f] = (x, y)
    at[500] = {900: (0.0, 0.0)}

    def brute(a, b):
        d = [(np.hypot(at[a][f][0] - at[b][f][0], at[a][f][1] - at[b][f][1]), f) for f in at[a].keys() & at[b].keys()]
        return (len(d), *min(d, default=(99999.0, -1)))

    every = [(a, b) for a in at for b in at if a != b]
    got = {(r["a"], r["b"]): (r["n"], r["min_dist"], r["min_frame"]) for r in intervals.path_distances(df).collect()}
    assert got.keys() == {p for p in every if p[0] < p[1] and brute(*p)[0]} and all(np.allclose(v, brute(*p)) for p, v in got.items())
    asked = {(r["a"], r["b"]): (r["n"], r["min_dist"], r["min_frame"]) for r in intervals.path_distances(df, spark.createDataFrame(every, "a int, b int")).collect()}
    assert asked.keys() == set(every) and all(np.allclose(v, brute(*p)) for p, v in asked.items())


def test_z_cases_need_a_fork(spark, monkeypatch):
    from trackweave.plans import queries as Q

    # 1 -> 10 <- 2 -> 11: a z; 3 -> 12 <- 4: none, as 4 has one successor; 5 -> 13 <- 6 -> 14, 15: none, as 6 has three
    edges = [(1, 10), (2, 10), (2, 11), (3, 12), (4, 12), (5, 13), (6, 13), (6, 14), (6, 15)]
    monkeypatch.setattr(Q, "_edges", lambda spark, d: spark.createDataFrame(edges, "src int, dst int"))
    assert [tuple(r) for r in Q.QUERIES["z_cases"](spark, "").collect()] == [(1, 10, 1)]


def test_sets_are_matched_as_by_brute_force(spark):
    from itertools import permutations

    import pandas as pd

    from trackweave.operators import kernels

    rng = np.random.default_rng(3)
    for n in (1, 2, 4):
        p = pd.DataFrame(rng.random((n + 1, n + 1)), index=[7, *range(n)], columns=[7, *range(10, 10 + n)])
        pairs, least, mean = kernels.match_sets(p)
        rest = p.drop(index=7, columns=7).to_numpy()
        best = max(sum(rest[i, q[i]] for i in range(n)) for q in permutations(range(n)))
        assert pairs[0] == (7, 7) and mean * n == pytest.approx(best) and least == pytest.approx(min(p.at[a, b] for a, b in pairs[1:]))
    assert kernels.match_sets(pd.DataFrame([[1.0]], index=[4], columns=[4])) == ([(4, 4)], 1.0, 1.0)


def test_matched_sets_follow_their_matrices(spark):
    from trackweave.plans.queries import QUERIES

    d = "/root/testdata/sf0.001"
    cells = {(r["cs"], r["a"], r["b"]): r["p"] for r in QUERIES["spatial_matching"](spark, d).collect()}
    rows = QUERIES["matched_sets"](spark, d).collect()
    firsts = [(r["cs"], r["a"]) for r in rows]
    assert rows and len(set(firsts)) == len(rows) and {(r["cs"], r["a"], r["b"]) for r in rows} <= set(cells)
    for cs, a, b in cells:
        if a == b:
            assert (cs, a, b) in {(r["cs"], r["a"], r["b"]) for r in rows}
    tracks = QUERIES["sequential_tracks"](spark, d).collect()
    assert len({r["tracklet_id"] for r in tracks}) == len(tracks) and all((r["place"] == 0) == (r["tracklet_id"] == r["track_id"]) for r in tracks)


def test_components_and_small_matchings_equal_brute_force():
    from itertools import permutations

    from trackweave.operators import kernels

    rng = np.random.default_rng(12)
    edges = sorted({(int(a), int(b)) for a, b in rng.integers(0, 30, (35, 2))})
    reach = {i: {i} for i in range(30)}  # sources that each source reaches
    for _ in range(30):
        for a, b in edges:
            for c, e in edges:
                if b == e:
                    reach[a] |= reach[c]
    assert kernels.bipartite_components(*map(list, zip(*edges, strict=True))) == [min(reach[a]) for a, _ in edges]
    for n in (2, 3, 4):
        score = {(i, 10 + j): float(rng.random()) for i in range(n) for j in range(n) if rng.random() < 0.7 or i == j}
        sums = sorted({(sum(score.get((i, t), -9) for i, t in enumerate(p) if t is not None), p) for p in set(permutations([*range(10, 10 + n), *[None] * n], n))}, key=lambda x: -x[0])
        cert, pairs = kernels.best_matching([(a, b, s) for (a, b), s in score.items()])
        assert dict(pairs) == {i: t for i, t in enumerate(sums[0][1]) if t is not None} and cert == pytest.approx(sums[0][0] / n * (sums[0][0] - sums[1][0]))


def test_headings_are_the_cheapest(spark):
    from itertools import product

    from trackweave.operators import kernels

    rng = np.random.default_rng(8)
    x, y, theta, major = rng.random(7) * 3, rng.random(7) * 3, rng.random(7) * np.pi, 2 + rng.random(7)

    def travel(turned):
        hx, hy = x + major * np.cos(-(theta + np.pi * turned)), y + major * np.sin(-(theta + np.pi * turned))
        return np.hypot(np.diff(hx), np.diff(hy)).sum()

    best = min(travel(np.array(t)) for t in product((0, 1), repeat=7))  # no step is longer than five pixels
    got = np.round(np.mod(kernels.orient(x, y, theta, major) - theta, 2 * np.pi) / np.pi)
    assert travel(got) == pytest.approx(best)


@pytest.mark.parametrize("name", ["remapped_ids", "active_tracklets", "frame_index"])
def test_orders_are_made_in_ranges(spark, name):
    from tests.oracle import compare
    from trackweave.plans.queries import QUERIES, SQL

    d, key = "/root/testdata/sf0.001", "spark.sql.adaptive.coalescePartitions.enabled"
    assert compare(spark, _duck(), name, QUERIES[name], SQL[name], d) == ""
    spark.conf.set(key, "false")  # else small results are put together
    try:
        assert QUERIES[name](spark, d).select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset(key)


def _labels(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        lo, hi = sorted((top(a), top(b)))
        up[hi] = lo
    return {x: top(x) for x in up}


def test_components_equal_union_find(spark, tmp_path):
    from trackweave.operators.components import bipartite_components, connected_components

    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rng = np.random.default_rng(11)
    chain, star = [(i, i + 1) for i in range(500, 560)], [(900, int(x)) for x in range(901, 1100)]
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (120, 2))] + chain[::-1] + star + [(7, 7), (3, 9), (9, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["vertex"]: r["component"] for r in connected_components(df, lambda x: x.checkpoint()).collect()}
    want = _labels([e for e in edges if e[0] != e[1]])
    assert got == want
    assert connected_components(df.limit(0), lambda x: x.checkpoint()).count() == 0
    two = spark.createDataFrame([(1, 1, 5), (2, 1, 6), (2, 3, 7), (9, 2, 8)], "src int, dst int, w int")
    assert sorted(map(tuple, bipartite_components(two, "src", "dst", lambda x: x.checkpoint()).collect())) == [(1, 1, 5, 1), (2, 1, 6, 1), (2, 3, 7, 1), (9, 2, 8, 9)]
