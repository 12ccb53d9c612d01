"""Tracks from complete sets: what is matched, what is refused, and that no track holds two tracklets of a frame."""

import random

import numpy as np
import pytest

from trackweave.operators import tracks as K


def _tracklet(i, start, end, look, at=(0.0, 0.0)):
    return K.Tracklet(i, start, end, at, at, [(np.array([float(look)]), float(end - start + 1), 1.0)])


def _sets(ts, k):
    frames = range(min(t.start for t in ts), max(t.end for t in ts) + 1)
    seen = [sorted(t.id for t in ts if t.start <= f <= t.end) for f in frames]
    return [s for i, s in enumerate(seen) if len(s) == k and (i == 0 or s != seen[i - 1])]


def test_sets_are_matched_in_order_and_groups_across_a_gap():
    ts = [_tracklet(1, 0, 9, 0), _tracklet(2, 0, 4, 10), _tracklet(3, 5, 9, 10), _tracklet(4, 20, 29, 10, (500, 0)), _tracklet(5, 20, 29, 0, (500, 0))]
    got, groups = K.solve(ts, _sets(ts, 2))
    assert {t.id: got.of(t.id) for t in ts} == {1: 1, 2: 2, 3: 2, 4: 2, 5: 1} and groups == [[1, 2]]
    assert got.how[3] == "sequential"


def test_bad_matches_open_a_group():
    ts = [_tracklet(1, 0, 9, 0), _tracklet(2, 0, 9, 10), _tracklet(3, 12, 21, 40), _tracklet(4, 12, 21, 50)]
    got, groups = K.solve(ts, _sets(ts, 2))
    assert [sorted(g) for g in groups] == [[1, 2], [3, 4]] and not got.how


def test_a_merge_that_repeats_a_track_is_a_conflict():
    """Group two looks like group one, but a third group holds tracks of both: merging would put one track into it twice."""
    t = K.Tracks({x.id: x for x in [_tracklet(1, 0, 9, 0), _tracklet(2, 0, 9, 30), _tracklet(3, 20, 24, 0), _tracklet(4, 20, 24, 30)]})
    groups = t.globally([[1, 2], [3, 4], [1, 3]])
    assert t.of(3) == 3 and len(groups) == 3


def test_leftovers_take_no_prohibited_identity():
    ts = [_tracklet(1, 0, 9, 0), _tracklet(2, 0, 9, 10), _tracklet(3, 12, 14, 10), _tracklet(4, 5, 13, 0)]
    got, _ = K.solve(ts, [[1, 2]])
    assert got.of(3) == 2 and got.how[3] == "best_set"
    assert got.of(4) == 4  # it shares frames with both


@pytest.mark.parametrize("seed", range(8))
def test_tracks_never_share_a_frame(seed):
    rng = random.Random(seed)
    ts = []
    for o in range(4):
        f = 0
        while f < 60:
            n = rng.randrange(1, 9)
            ts.append(_tracklet(len(ts), f, f + n - 1, o * 3 + rng.gauss(0, 0.5), (rng.uniform(0, 40), 0)))
            f += n + rng.choice([0, 0, 0, 1, 5])
    got, groups = K.solve(ts, _sets(ts, 4))
    for t in {got.of(x.id) for x in ts}:
        own = sorted((got.tracklets[x].start, got.tracklets[x].end) for x in got.members[t])
        assert all(a[1] < b[0] for a, b in zip(own, own[1:], strict=False))
    assert sorted(x for m in got.members.values() for x in m) == [t.id for t in ts]
    assert all(len(set(g)) == len(g) for g in groups) and (not groups or got.how)


def test_prototypes_are_merged_by_weight():
    p = [(np.array([float(i)]), 1.0, 0.5) for i in (0, 10, 20)]
    got = K.merged_prototypes(p, [(np.array([1.0]), 3.0, 1.0), (np.array([30.0]), 1.0, 0.0), (np.array([40.0]), 1.0, 0.0)])
    assert len(got) == 5 and got[0][0][0] == pytest.approx(0.75) and got[0][1:] == (4.0, pytest.approx(0.875))
