"""Cardinalities, dense subgraphs, paths and transport against brute force."""

import random
from itertools import permutations, product

import pytest

from trackweave.operators import flow, graph


def _cheapest(spans, cost, total, before, after):
    """All cardinalities: least unseen objects, then least cost."""
    frames, best = sorted({f for s in spans.values() for f in s}), None
    for k in product(range(total + 1), repeat=len(spans)):
        k = dict(zip(spans, k, strict=True))
        held = [sum(k[t] for t, (a, b) in spans.items() if a <= f <= b) for f in frames]
        if max(held) > total or any(k[t] > sum(k[x] for x in own) for rule in (before, after) for t, own in rule.items()):
            continue
        found = (sum(total - h for h in held), sum(cost[t][k[t]] for t in k))
        if best is None or found < best:
            best = found
    return best


@pytest.mark.parametrize("seed", range(25))
def test_cardinalities_equal_enumeration(seed):
    rng = random.Random(seed)
    total, n = rng.choice([(1, 12), (2, 8), (3, 6)])
    spans = {i: (a := rng.randrange(8), a + rng.randrange(4)) for i in range(n)}
    cost = {t: flow.area_costs(rng.choice([20, 90, 110, 170, 190, 260, 400]), 100.0, b - a + 1, total) for t, (a, b) in spans.items()}
    behind = {t: [x for x in spans if spans[x][1] + 1 == spans[t][0]] for t in spans}
    before = {t: x for t, x in behind.items() if x and rng.random() < 0.7}
    after = {t: x for t in spans if (x := [y for y in spans if t in behind[y]]) and rng.random() < 0.3}
    want = _cheapest(spans, cost, total, before, after)
    got, unseen, spent = flow.Cardinalities(spans, cost, total, before, after).solve()
    assert (unseen, spent) == (want[0], pytest.approx(want[1])) and spent == pytest.approx(sum(cost[t][k] for t, k in got.items()))
    assert all(got[t] <= sum(got[x] for x in own) for rule in (before, after) for t, own in rule.items())


def test_cardinalities_of_the_known_case():
    """Two tracklets that merge: areas 110, 85, then 180; a fourth of 400 can hold no one beside the two."""
    spans, areas = {1: (0, 4), 2: (0, 4), 3: (0, 9), 4: (5, 9)}, {1: 110, 2: 85, 3: 400, 4: 180}
    got, unseen, _ = flow.Cardinalities(spans, {t: flow.area_costs(a, 100, 5, 2) for t, a in areas.items()}, 2, {4: [1, 2]}).solve()
    assert (got, unseen) == ({1: 1, 2: 1, 3: 0, 4: 2}, 0)


def test_many_tracklets_take_no_long_search():
    rng = random.Random(4)
    spans = {i: (a := rng.randrange(400), a + rng.randrange(6)) for i in range(600)}
    cost = {t: [abs(k * 100 - area) * 3.0 for k in range(6)] for t in spans for area in [rng.randrange(50, 400)]}
    got, unseen, _ = flow.Cardinalities(spans, cost, 5).solve()  # convex costs, no rule: one flow
    frames = sorted({f for s in spans.values() for f in s})
    held = [sum(got[t] for t, (a, b) in spans.items() if a <= f <= b) for f in frames]
    assert max(held) <= 5 and sum(5 - h for h in held) == unseen


@pytest.mark.parametrize("seed", range(12))
def test_transport_equals_enumeration(seed):
    """Whole areas as unit grains: the cheapest of all ways to pair them."""
    rng = random.Random(seed)
    p, q = ([rng.randrange(1, 4) for _ in range(rng.randrange(1, 4))] for _ in "pq")
    cost = [[rng.randrange(1, 20) for _ in q] for _ in p]
    a, b = ([i for i, x in enumerate(side) for _ in range(x)] for side in (p, q))
    if len(a) > len(b):
        a, b, turned = b, a, True
    else:
        turned = False
    price = lambda i, j: cost[j][i] if turned else cost[i][j]
    want = min(sum(price(i, j) for i, j in zip(a, x, strict=True)) for x in set(permutations(b, len(a))))
    got, amount = flow.transport(p, q, cost)
    assert got == pytest.approx(want) and sum(map(sum, amount)) == len(a)
    assert all(sum(row) <= x for row, x in zip(amount, p, strict=True)) and all(sum(c) <= x for c, x in zip(zip(*amount, strict=True), q, strict=True))


def _longest(links, w):
    after = {v: [b for a, b in links if a == v] for v in w}
    memo = {}

    def best(v):
        if v not in memo:
            memo[v] = w[v] + max((best(x) for x in after[v]), default=0)
        return memo[v]

    return {v: best(v) for v in w}


def test_longest_paths_equal_depth_first_search(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rng = random.Random(2)
    w = {i: rng.randrange(1, 6) for i in range(60)}
    links = sorted({(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(140)) if a < b})
    got = graph.longest_paths(spark.createDataFrame(links, "a long, b long"), spark.createDataFrame(list(w.items()), "vertex long, w int"), lambda x: x.checkpoint())
    rows = {r["vertex"]: r for r in got.collect()}
    assert {v: r["total"] for v, r in rows.items()} == _longest(links, w)
    for v, r in rows.items():  # next vertices lead along a path of that weight
        at, total, hops = v, w[v], 0
        while rows[at]["next"] is not None:
            assert (at, rows[at]["next"]) in links
            at, hops = rows[at]["next"], hops + 1
            total += w[at]
        assert (total, hops) == (r["total"], r["hops"])


def test_dense_subgraphs_equal_closure(spark, tmp_path):
    from trackweave.plans.dense_queries import dense_members

    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rng = random.Random(3)
    label = {i: rng.choice([0, 0, 1, 1, 2]) for i in range(80)}
    links = sorted({(rng.randrange(80), rng.randrange(80)) for _ in range(90)})
    got = dense_members(spark.createDataFrame(links, "a long, b long"), spark.createDataFrame(list(label.items()), "tracklet_id long, label int"), lambda x: x.checkpoint())
    want, rest = set(), {i for i in label if label[i] == 1}
    while rest:
        inner, queue = set(), [min(rest)]
        while queue:
            t = queue.pop()
            inner.add(t)
            queue += [x for a, b in links for x, y in ((a, b), (b, a)) if y == t and label[x] == 1 and x not in inner]
        rest -= inner
        into = {a for a, b in links if b in inner and label[a] == 0}
        out = {b for a, b in links if a in inner and label[b] == 0}
        want |= {(min(inner), t, "multi") for t in inner} | {(min(inner), t, "in_out" if t in into & out else "in" if t in into else "out") for t in into | out}
    assert set(map(tuple, got.collect())) == want


def test_merged_boxes_equal_a_quadratic_loop(spark, tmp_path):
    from trackweave.operators.boxes import merged_boxes

    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rng = random.Random(7)
    rows = [(f, f * 1000 + i, x := rng.randrange(-30, 200), y := rng.randrange(200), x + rng.randrange(1, 25), y + rng.randrange(1, 25)) for f in range(4) for i in range((5, 25, 60, 120)[f])]
    rows += [(9, 9000, 0, 0, 5, 5), (9, 9001, 5, 5, 7, 7), (9, 9002, 8, 8, 9, 9), (9, 9003, 6, 0, 6, 90), (9, 9004, 30, 80, 31, 81)]
    rows += [(10, 9100 + i, i * 3, 0, i * 3 + 3, 1) for i in range(40)]  # a chain: one box in the end
    got = merged_boxes(spark.createDataFrame(rows, "frame int, box_id long, x1 int, y1 int, x2 int, y2 int"), lambda x: x.checkpoint())
    want = set()
    for f in {r[0] for r in rows}:
        left = [(r[1], *r[2:], 1) for r in rows if r[0] == f]
        while hit := next(((a, b) for a in left for b in left if a is not b and a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]), None):
            a, b = hit
            left.remove(a)
            left.remove(b)
            left.append((min(a[0], b[0]), min(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3]), max(a[4], b[4]), a[5] + b[5]))
        want |= {(f, *x) for x in left}
    assert set(map(tuple, got.select("frame", "box_id", "x1", "y1", "x2", "y2", "n").collect())) == want
