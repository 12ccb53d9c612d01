"""Tracks of one arena from its complete sets: matched in time order, then group by group, then what is left over."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

from trackweave.operators import kernels

Prototype = tuple[np.ndarray, float, float]
#: Cost of an identity that a track can't have; what it costs at least is no match.
PROHIBITED = 1e6


@dataclass
class Tracklet:
    id: int
    start: int
    end: int
    head: tuple[float, float]
    tail: tuple[float, float]
    prototypes: list[Prototype]


def merged_prototypes(a: Sequence[Prototype], b: Sequence[Prototype], most: int = 5) -> list[Prototype]:
    """Prototypes of both; while there are too many, the two nearest become their weighted mean."""
    out = [*a, *b]
    while len(out) > most:
        _, i, j = min((float(np.linalg.norm(out[i][0] - out[j][0])), i, j) for i in range(len(out)) for j in range(i + 1, len(out)))
        (x, v, s), (y, w, t) = out[i], out[j]
        out[i] = ((x * v + y * w) / (v + w), v + w, (s * v + t * w) / (v + w))
        del out[j]
    return out


@dataclass
class Tracks:
    """Tracklets put together to tracks: a union-find in which tracks that share a frame can't be one.

    ``how`` says by which step a tracklet came to its track.
    """

    tracklets: dict[int, Tracklet]
    reach: float = 20.0
    neutral: float = 0.5
    accepted: float = 0.3
    up: dict[int, int] = field(default_factory=dict)
    members: dict[int, list[int]] = field(default_factory=dict)
    prototypes: dict[int, list[Prototype]] = field(default_factory=dict)
    how: dict[int, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for t in sorted(self.tracklets):
            self.up[t], self.members[t], self.prototypes[t] = t, [t], list(self.tracklets[t].prototypes)

    def of(self, t: int) -> int:
        """The track of a tracklet, by the tracklet that it began with; ways are shortened."""
        while self.up[t] != t:
            self.up[t] = self.up[self.up[t]]
            t = self.up[t]
        return t

    def meet(self, a: int, b: int) -> bool:
        """Whether two tracks share a frame."""
        t = self.tracklets
        return any(t[x].start <= t[y].end and t[y].start <= t[x].end for x in self.members[a] for y in self.members[b])

    def merge(self, a: int, b: int, how: str) -> None:
        for t in self.members[b]:
            self.how[t] = how
        for t in self.members[a]:
            self.how.setdefault(t, how)
        self.up[b] = a
        self.members[a] = sorted(self.members[a] + self.members.pop(b), key=lambda t: (self.tracklets[t].start, t))
        self.prototypes[a] = merged_prototypes(self.prototypes[a], self.prototypes.pop(b))

    def likeness(self, a: int, b: int) -> float:
        return min(1.0, kernels.prototype_similarity(self.prototypes[a], self.prototypes[b]))

    def nearness(self, a: int, b: int) -> float:
        """How likely track b goes on where a ends; neutral where that is far, 0 if it begins before."""
        last, first = max((self.tracklets[t] for t in self.members[a]), key=lambda t: t.end), min((self.tracklets[t] for t in self.members[b]), key=lambda t: t.start)
        gap = first.start - last.end
        if gap < 0:
            return 0.0
        far = float(np.hypot(last.tail[0] - first.head[0], last.tail[1] - first.head[1])) / self.reach
        return max(self.neutral, (1 - far) ** gap if far <= 1 else 0.0)

    def match(self, one: Sequence[int], two: Sequence[int], near: bool) -> tuple[list[tuple[int, int]], float]:
        """Tracks of two sets in pairs, and the mean probability of those that differ (1 if none do). Tracks that share a frame are no pair."""
        shared = sorted(set(one) & set(two))
        a, b = sorted(set(one) - set(shared)), sorted(set(two) - set(shared))
        pairs = [(t, t) for t in shared]
        if not a or not b:
            return pairs, 1.0
        p = np.array([[0.0 if self.meet(x, y) else self.likeness(x, y) * (self.nearness(x, y) if near else 1.0) for y in b] for x in a])
        cells = kernels.assignment(1 - p)
        return pairs + [(a[r], b[c]) for r, c in cells], float(np.mean([p[r, c] for r, c in cells]))

    def sequential(self, sets: Sequence[Sequence[int]]) -> list[list[int]]:
        """Each complete set with the next: a good match merges their tracks, a bad one opens a group. The groups, by their tracks."""
        groups: list[list[int]] = []
        for i, s in enumerate(sets):
            now = sorted({self.of(t) for t in s})
            if i:
                pairs, quality = self.match(sorted({self.of(t) for t in sets[i - 1]}), now, True)
                if quality > self.accepted:
                    for x, y in pairs:
                        if x != y and not self.meet(x, y):
                            self.merge(x, y, "sequential")
                    continue
            groups.append(now)
        return [sorted({self.of(t) for t in g}) for g in groups]

    def support(self, group: Sequence[int]) -> int:
        return sum(self.tracklets[t].end - self.tracklets[t].start + 1 for x in group for t in self.members[x])

    def globally(self, groups: list[list[int]]) -> list[list[int]]:
        """Groups matched to the one of the most frames, the best match first, whatever lies between. A match that would give
        one group the same track twice is a conflict and isn't tried again. The groups that are left, the largest first."""
        groups = [sorted(set(g)) for g in groups]
        refused: set[tuple[tuple[int, ...], tuple[int, ...]]] = set()
        while len(groups) > 1:
            groups.sort(key=lambda g: (-self.support(g), g))
            for i, pivot in enumerate(groups):
                tried = [(self.match(pivot, g, False), g) for g in groups[i + 1 :] if (tuple(pivot), tuple(g)) not in refused]
                tried = [x for x in tried if x[0][1] > self.accepted]
                if tried:
                    break
            else:
                return groups
            (pairs, _), best = max(tried, key=lambda x: (x[0][1], [-t for t in x[1]]))
            new = {y: x for x, y in pairs}
            rest = [[new.get(t, t) for t in g] for g in groups if g is not best]
            if any(len(set(g)) < len(g) for g in rest) or any(x != y and self.meet(x, y) for x, y in pairs):
                refused.add((tuple(pivot), tuple(best)))
                continue
            for x, y in pairs:
                if x != y:
                    self.merge(x, y, "global")
            groups = [sorted(g) for g in rest]
        return groups

    def leftovers(self, best: Sequence[int]) -> None:
        """Tracklets outside of the best group, each with the most others of its kind that share one of its frames: matched to the
        group's tracks by likeness. Identities of tracks that share a frame are prohibited."""
        own = set(best)
        for t in sorted(self.tracklets, key=lambda t: (self.tracklets[t].start, t)):
            if self.of(t) in own:
                continue
            open_ = [x for x in self.tracklets if self.of(x) not in own]
            at = self.tracklets[t]
            crowd = max(([x for x in open_ if self.tracklets[x].start <= f <= self.tracklets[x].end] for f in range(at.start, at.end + 1)), key=len)
            some, targets = sorted({self.of(x) for x in crowd}), sorted(own)
            cost = np.array([[PROHIBITED if self.meet(x, y) else 1 - self.likeness(x, y) for y in targets] for x in some])
            cells = [(r, c) for r, c in kernels.assignment(cost) if cost[r, c] < PROHIBITED]
            if cells and 1 - float(np.mean([cost[r, c] for r, c in cells])) > self.accepted:
                for r, c in cells:
                    if not self.meet(targets[c], some[r]):
                        self.merge(targets[c], some[r], "best_set")


def solve(tracklets: Sequence[Tracklet], sets: Sequence[Sequence[int]], **options: float) -> tuple[Tracks, list[list[int]]]:
    """All three steps: the tracks and the groups that stayed apart."""
    tracks = Tracks({t.id: t for t in tracklets}, **options)
    groups = tracks.globally(tracks.sequential(sets))
    if groups:
        tracks.leftovers(groups[0])
    return tracks, groups
