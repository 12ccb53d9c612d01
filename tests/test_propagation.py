"""Identity sets: the rounds equal a sequential loop, and a plain loop over rounds where identities run out."""

import random

import pytest

from trackweave.operators.propagation import BITS, propagate


def _world(seed, total, honest):
    """Objects that go on as tracklets one after the other; links hold the true successor and others (or, dishonest, any)."""
    rng = random.Random(seed)
    tracklets, frames, links, last = {}, {}, set(), {}
    for o in range(total):
        f = rng.randrange(3)
        while f < 24:
            n, t = rng.randrange(1, 5), len(tracklets)
            tracklets[t] = {"object": o, "start": f, "end": f + n - 1, "single": rng.random() < 0.8, "noise": False}
            frames[t] = set(range(f, f + n))
            if o in last and tracklets[last[o]]["end"] == f - 1:
                links.add((last[o], t))
            last[o] = t
            f += n + (rng.randrange(3) if rng.random() < 0.2 else 0)
    for a in tracklets:
        for b in tracklets:
            if tracklets[a]["end"] + 1 == tracklets[b]["start"] and rng.random() < 0.15:
                links.add((a, b))
    if honest:  # a tracklet whose true neighbour is missing has no links on that side
        true = {(a, b) for a, b in links if tracklets[a]["object"] == tracklets[b]["object"]}
        links = {(a, b) for a, b in links if any(y == b for _, y in true) and any(x == a for x, _ in true)}
        known_b, known_a = {y for _, y in true}, {x for x, _ in true}
        links = {(a, b) for a, b in links if b in known_b and a in known_a}
    else:
        links = {x for x in links if rng.random() < 0.6}
        for t in tracklets.values():
            t["noise"] = rng.random() < 0.1
    for t in tracklets.values():
        t["identity"] = t["object"] if rng.random() < 0.35 else None
    return tracklets, frames, links


def _sequential(tracklets, frames, links, total):
    """Each change is carried on before the next is looked at."""
    ids, no, who = set(range(total)), {t: set() for t in tracklets}, {}
    before, after = ({t: [x for x in tracklets if ((x, t) if k else (t, x)) in links] for t in tracklets} for k in (1, 0))

    def exclude(t, more):
        if t in who and who[t] in more or more <= no[t]:
            return
        no[t] |= more
        for side, back in ((after, before), (before, after)):
            for x in side[t]:
                if x not in who:
                    around = [no[y] for y in back[x] if not tracklets[y]["noise"]]
                    if around:
                        exclude(x, set.intersection(*around))
        if t not in who and tracklets[t]["single"] and len(no[t]) == total - 1:
            decide(t, (ids - no[t]).pop())

    def decide(t, i):
        who[t] = i
        exclude(t, ids - {i})
        for x in tracklets:
            if x not in who and frames[x] & frames[t]:
                exclude(x, {i})

    for t, x in tracklets.items():
        if x["identity"] is not None and t not in who:
            decide(t, x["identity"])
    return no, who


def _rounds(tracklets, frames, links, total):
    """All changes of a round at once."""
    ids = set(range(total))
    who = {t: x["identity"] for t, x in tracklets.items() if x["identity"] is not None}
    no = {t: ids - {who[t]} if t in who else set() for t in tracklets}
    fresh, moved, when, turn = set(who), set(who), dict.fromkeys(who, 0), 0
    while moved:
        turn += 1
        new = {t: set(x) for t, x in no.items()}
        for t in tracklets:
            if t in who:
                continue
            for k in (0, 1):
                around = [x for x in tracklets if ((x, t) if k else (t, x)) in links]
                if moved & set(around) and (sets := [no[x] for x in around if not tracklets[x]["noise"]]):
                    new[t] |= set.intersection(*sets)
            new[t] |= {who[x] for x in fresh if frames[x] & frames[t]}
        fresh = {t for t in tracklets if t not in who and tracklets[t]["single"] and len(new[t]) == total - 1}
        moved = fresh | {t for t in tracklets if new[t] != no[t]}
        who |= {t: (ids - new[t]).pop() for t in fresh}
        when |= dict.fromkeys(fresh, turn)
        no = new
    return no, who, when


def _run(spark, tracklets, frames, links, total):
    t = spark.createDataFrame([(i, 0, x["identity"], x["single"], x["noise"], total) for i, x in tracklets.items()], "tracklet_id long, arena int, identity int, single boolean, noise boolean, total int")
    f = spark.createDataFrame([(i, x) for i, fs in frames.items() for x in fs], "tracklet_id long, frame int")
    rows = propagate(t, f, spark.createDataFrame(sorted(links), "a long, b long"), lambda x: x.checkpoint()).collect()
    no, when = {i: set() for i in tracklets}, {}
    for r in rows:
        no[r["tracklet_id"]] |= {r["word"] * BITS + b for b in range(BITS) if r["no"] >> b & 1}
        if r["decided"]:
            when[r["tracklet_id"]] = r["round"]
    return no, when


@pytest.mark.parametrize(("seed", "total"), [(1, 5), (2, 9), (3, 70)])
def test_sets_equal_the_sequential_loop(spark, tmp_path, seed, total):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    world = _world(seed, total, True)
    no, when = _run(spark, *world, total)
    want, who = _sequential(*world, total)
    assert no == want and set(when) == set(who)
    assert any(when.values())  # some were decided by propagation


@pytest.mark.parametrize("seed", [4, 5, 6])
def test_rounds_where_identities_run_out(spark, tmp_path, seed):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    world = _world(seed, 4, False)
    no, when = _run(spark, *world, 4)
    want, _, turns = _rounds(*world, 4)
    assert no == want and when == turns
