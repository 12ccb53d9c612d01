"""Near-duplicates by bottom-k sketches from one hash function (operator 7).

Documents with the same shingle set are one class. Three steps find all links between classes:

1. Screening. If two sets are alike enough, at least ``least_shared(SCREEN)`` of their ``SCREEN``
   least hashes are in both. Classes that share fewer with the whole corpus have no partner.
2. Inverted lists. The remaining classes keep their ``k`` least hashes, so a set of at most ``k``
   shingles is kept whole, and order them by rarity. Two classes that share
   at least ``t`` of ``h`` values meet in the first ``h - t + 1`` of them (the prefix principle), so
   only those make lists, and common passages make none. At the first value that a pair shares, the
   values behind it must still reach the overlap; that drops nearly all pairs that aren't alike.
3. Decisions. Small sets are in the sketches and decide at once. For others the union sketch
   estimates, and the full sets decide.

Lists yield pairs in rounds: first every member with the list's leader, then, once components are
known, the members outside of the list's main component with all others. Those meet by bands of set
sizes, and only where each side alone has values enough for partners of the other's size, so members
that share a template without being alike are never joined; and at the first list that holds both, so
copies with the same changes make one pair, not one for each value of these changes. Where sketches aren't
whole sets, bounds are binomial quantiles with a chance below ``TAIL`` to lose a link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.llm.components import components
from trackweave.llm.scratch import dropped, lean, small_batches, stored
from trackweave.session import reach_workers

SHINGLE, PERCENT = 5, 75
#: Values of a class that passes the screening, and those that the screening looks at.
SKETCH, SCREEN = 512, 32
TAIL = 5e-9
#: Rounds of leaders at most before all remaining pairs are looked at, and the latter at once if they are so many times the lists' rows.
LEADER_ROUNDS, FEW_PAIRS = 3, 4
#: Bands of set sizes between a set and the largest that is alike enough.
BANDS = 8
#: Values before its own that a list entry carries. Pairs that met at one of both sides' aren't made again; a longer way back only makes a pair twice.
BEFORE = 16
#: Ids that are broadcast at most to pick rows; beyond, the join shuffles.
BROADCAST_IDS = 500_000
#: Bytes of a text that are hashed at a time.
CHUNK = 1 << 20

_BASE, _MIX1, _MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX2)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse (modulo 2**64), ``2**bits`` of each."""
    out = []
    for x in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(1 << bits, x, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def _word_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of each run of bytes that are no white space."""
    inside = np.concatenate(([False], ~_SPACE[raw], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    bits = len(raw).bit_length()
    # texts of a longest word beyond a chunk are rare: their powers aren't remembered
    up, down = _powers(bits) if bits <= CHUNK.bit_length() else _powers.__wrapped__(bits)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])))
    return _mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; a text of fewer words has one, without words none."""
    raw = np.frombuffer(text.encode().lower(), np.uint8)  # bytes.lower() changes A-Z only
    parts, at = [], 0
    while at < len(raw):
        end = at + CHUNK
        while end < len(raw) and not _SPACE[raw[end]]:  # a chunk ends before white space
            end += 1
        parts.append(_word_hashes(raw[at:end]))
        at = end
    words = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    if not len(words):
        return words
    n = min(size, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = _mixed(out * np.uint64(_BASE) + words[i : len(words) - n + 1 + i])
    return np.unique(out)


def least_shared(k: int, likely: float = PERCENT / 100) -> int:
    """The number of successes of ``k`` draws that is missed with a chance of at most ``TAIL``."""
    chance, x = 0.0, 0
    while x < k:
        chance += comb(k, x) * likely**x * (1 - likely) ** (k - x)
        if chance > TAIL:
            break
        x += 1
    return x


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _long_lists(sets: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    values = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, so that a batch of long texts isn't doubled in memory as Python strings and sets."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _rows(docs: DataFrame, shingle: int, k: int) -> DataFrame:
    """Each row's id, class (a digest of its set), set size and sketch. Ids pass as Arrow values, so null ids change none."""
    kind = docs.schema["id"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches):
            classes, sizes, least = [], [], []
            for t in b.column("text"):
                s = shingle_hashes(t.as_py(), shingle)
                classes.append(_digest(s))
                sizes.append(len(s))
                least.append(s[:k].copy())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(classes, pa.binary()), pa.array(sizes, pa.int64()), _long_lists(least)], ["id", "class", "n", "sketch"])

    return docs.mapInArrow(lean(sketch), f"id {kind}, class binary, n bigint, sketch array<bigint>")


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int, k: int | None = None) -> DataFrame:
    """Shingle sets (``c``, ``set``) of the wanted classes (``c``, ``id``, ``class``), or their ``k`` least values: made anew from their texts."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches, 100):
            sets = [shingle_hashes(t.as_py(), shingle) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(list(map(_digest, sets)), pa.binary()), _long_lists([s[:k] for s in sets])], ["class", "set"])

    ids, numbers = wanted.select("id").distinct(), wanted.select("c", "class")
    if ids.count() <= BROADCAST_IDS:
        ids, numbers = F.broadcast(ids), F.broadcast(numbers)
    texts = docs.join(ids, "id", "left_semi")
    return texts.mapInArrow(lean(build), "class binary, set array<bigint>").join(numbers, "class").dropDuplicates(["c"]).select("c", "set")


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, k: int = SKETCH, screen: int = SCREEN,
) -> DataFrame:
    """Group near-duplicates; one row for each input row: the id, ``n_shingles``, ``component_id``, ``kept``.

    Two documents are linked if their sets of ``shingle``-word shingles have a Jaccard similarity
    of at least 0.75. ``component_id`` is the least id that links reach; ``kept`` marks its row.

    Defined cases: a null text, or one without words, has an empty set and no link; rows with a
    null id are never linked, get no component and are kept; rows that repeat an id get a row
    each and are one node; an empty table gives no rows; other columns are ignored.
    """
    reach_workers(docs.sparkSession)
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = stored(_rows(docs, shingle, screen), "sketches")
    named = rows.filter("n > 0 AND id IS NOT NULL")
    # Exact copies meet in each task before they are shuffled.
    first = named.groupBy("class").agg(F.min("id").alias("id"), F.min_by(F.struct("n", F.col("sketch").alias("least")), "id").alias("x"))
    classes = stored(first.select(F.monotonically_increasing_id().alias("c"), "class", "id", "x.n", "x.least"), "classes")
    links = _links(docs, classes, shingle, k, screen)
    # An id with several texts is one node: it links the classes of all of them.
    several = named.groupBy("id").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo <> hi").select("id", "lo")
    numbers = classes.select("class", "c")
    same = named.select("id", "class").join(several, "id").filter("class <> lo").select("class", "lo").distinct()
    same = same.join(numbers.select("class", F.col("c").alias("a")), "class").join(numbers.select(F.col("class").alias("lo"), F.col("c").alias("b")), "lo").select("a", "b")
    found = components(links.unionByName(same))
    member = classes.join(found, classes["c"] == found["node"], "left").select("class", "id", F.coalesce("component", "c").alias("comp"))
    least = member.groupBy("comp").agg(F.min("id").alias("component_id"))
    of_class = member.join(least, "comp").select(F.col("class").alias("__class"), "component_id")
    out = rows.join(of_class, (rows["class"] == F.col("__class")) & rows["id"].isNotNull() & (rows["n"] > 0), "left")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(True)).alias("kept"),
    )


def _required(n: Column, k: int) -> Column:
    """The least number of kept values that a class of ``n`` shingles shares with any class that is alike.

    Up to ``k`` shingles the overlap is at least 3/4 of the set; a larger partner has up to n / 3
    shingles that its own sketch may lack. Beyond, the overlap in the sketches is a random draw.
    """
    whole = F.ceil(n * PERCENT / 100)
    return F.when(n * 100 <= k * PERCENT, whole).when(n <= k, F.least(whole, k - F.floor(n / 3))).otherwise(F.lit(least_shared(k))).cast("int")


def _met(values: DataFrame) -> DataFrame:
    """Values (``value``, ...) that several classes hold, with their number of classes ``df``."""
    often = values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    return values.join(often.hint("shuffle_hash"), "value")


def _screened(classes: DataFrame, screen: int) -> DataFrame:
    """Classes that share as many of their least values with the corpus as a partner asks for."""
    met = _met(classes.select("c", F.explode("least").alias("value"))).groupBy("c").agg(F.count(F.lit(1)).alias("met"))
    some = classes.select("c", "class", "id", "n").join(met, "c")
    return some.filter(F.col("met") >= _required(F.col("n"), screen)).drop("met")


def _prefix_lists(sketches: DataFrame, k: int) -> DataFrame:
    """Inverted lists of each class's rarest kept values: ``value``, ``df``, ``c``, ``n``, ``left`` (values from it on)."""
    held = F.least(F.col("n"), F.lit(k))
    met = _met(sketches.select("c", "n", F.explode("sketch").alias("value")))
    per = met.groupBy("c", "n").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("v"))
    # Values that no other class holds are the rarest; they take their places in the prefix and make no list.
    alone = held - F.size("v")
    prefix = F.slice("v", F.lit(1), F.greatest(F.lit(0), held - _required(F.col("n"), k) + 1 - alone).cast("int"))
    return per.select("c", "n", F.posexplode(prefix).alias("at", "v"), alone.alias("alone"), held.alias("held")).select(
        "v.value", "v.df", "c", F.col("n").cast("int").alias("n"), (F.col("held") - F.col("alone") - F.col("at")).cast("int").alias("left"),
    )


def _distinct_lists(lists: DataFrame) -> DataFrame:
    """Of lists with the same members the first in the order of values: it is where each pair of them meets first."""
    members = [F.bit_xor(F.xxhash64("c", F.lit(seed))).alias(f"s{seed}") for seed in (1, 2)]
    each = lists.groupBy("value").agg(F.min("df").alias("df"), F.count(F.lit(1)).alias("m"), *members).filter("m > 1")
    kept = each.groupBy("m", "s1", "s2").agg(F.min(F.struct("df", "value")).alias("v")).select("v.value")
    return lists.join(kept, "value", "left_semi").drop("df")


def _drawn(k: int, share: Column) -> Column:
    """Kept values that two sketches share at least if the larger set's are shared with a chance of ``share``, from 3/4 to 6/7."""
    low, high, steps = PERCENT / 100, 6 / 7, 50
    least = F.array(*[F.lit(least_shared(k, low + i * (high - low) / steps)) for i in range(steps + 1)])
    at = F.floor((share - low) / (high - low) * steps - 1e-6)
    return F.element_at(least, F.greatest(F.lit(0), F.least(F.lit(steps), at)).cast("int") + 1)


def _may_reach(k: int) -> Column:
    """Whether two list entries (n, left) and (n2, left2) can share enough if this is the first value they share.

    Whole sets: 7 * overlap >= 3 * (n + n2). Otherwise each kept value of the larger set is shared
    with a chance of at least overlap / larger, and the quantile of that chance is asked for.
    """
    large, both = F.greatest("n", "n2"), F.col("n") + F.col("n2")
    reach = F.least("left", "left2")
    return (F.least("n", "n2") * 100 >= large * PERCENT) & F.when(large <= k, reach * 7 >= both * 3).otherwise(reach >= _drawn(k, both * 3 / (large * 7)))


def _banded(entries: DataFrame, k: int, larger: bool) -> DataFrame:
    """List entries by the band of the smaller set and the bands ``off`` between it and the larger, for all partners that an entry can reach.

    An entry takes part as the smaller or as the larger set if its own values suffice for the least
    demand of any partner in the other's band.
    """
    step, slack = log(100 / PERCENT) / BANDS, 1e-9
    edge = lambda band: F.exp(band * step)
    n, own = F.col("n"), F.floor(F.log("n") / step)
    e = entries.withColumn("off", F.explode(F.sequence(F.lit(0), F.lit(BANDS + 1)))).withColumn("band", (own - F.col("off") if larger else own).cast("int"))
    if larger:
        other = F.least(n, edge(F.col("band")) * (1 - slack))  # the smaller set has as many at least
        need = F.when(n <= k, 3 * (other + n) / 7).otherwise(_drawn(k, 3 / 7 * (1 + other / n)))
    else:
        lo = F.greatest(n, edge(F.col("band") + F.col("off")) * (1 - slack))
        hi = F.greatest(n, edge(F.col("band") + F.col("off") + 1) * (1 + slack))
        whole, drawn = 3 * (n + lo) / 7, _drawn(k, 3 / 7 * (1 + n / hi)).cast("double")
        need = F.when(hi <= k, whole).when(lo > k, drawn).otherwise(F.least(whole, drawn))
    return e.filter(F.col("left") >= need - 1e-6)


def _with_before(lists: DataFrame) -> DataFrame:
    """List entries with ``before``: the last values of their class's other entries that precede theirs.

    All classes have their values in one order, so a value that is in two of these was shared first, where
    more values are left for both: what may reach the overlap here may reach it there.
    """
    back = Window.partitionBy("c").orderBy(F.desc("left"), "value").rowsBetween(-BEFORE, -1)
    return lists.withColumn("before", F.collect_list("value").over(back))


def _band_pairs(some: DataFrame, others: DataFrame, k: int) -> DataFrame:
    """Pairs ``a``, ``b`` of one of ``some`` as the smaller set and one of ``others`` as the larger, of other components, that may reach the overlap.

    With ``before`` on both sides, a pair is made where it meets first.
    """
    y = _banded(others, k, True)
    y = y.select("value", "band", "off", *[F.col(x).alias(f"{x}2") for x in ("c", "n", "left", "comp", "before") if x in y.columns])
    met = _banded(some, k, False).join(y, ["value", "band", "off"])
    first = (F.col("n") < F.col("n2")) | ((F.col("n") == F.col("n2")) & (F.col("c") < F.col("c2")))
    if "before" in some.columns and "before" in others.columns:
        first &= ~F.arrays_overlap("before", "before2")
    return met.filter(first & (F.col("comp") != F.col("comp2")) & _may_reach(k)).select(F.least("c", "c2").alias("a"), F.greatest("c", "c2").alias("b"))


def _links(docs: DataFrame, classes: DataFrame, shingle: int, k: int, screen: int) -> DataFrame:
    """Links between classes: ``a`` and ``b``, their numbers; all that components need."""
    active = stored(_screened(classes, screen), "active")
    kept = _sets(docs, active, shingle, k).withColumnRenamed("set", "sketch")
    sketches = stored(kept.join(active, "c").select("c", "class", "id", "n", "sketch"), "active-sketches")
    lists = stored(_distinct_lists(stored(_prefix_lists(sketches, k), "all-lists")), "lists")
    size, hub = lists.count(), F.min(F.struct(F.least("n", F.lit(k)) - F.col("left"), "c", "n", "left"))
    links, tested, inside, idle = classes.select(F.col("c").alias("a"), F.col("c").alias("b")).limit(0), [], None, False
    for turn in range(LEADER_ROUNDS + 1 if size else 0):
        if turn == 0:
            these, last = lists.withColumn("comp", F.col("c")), False
        else:
            these, work = _apart(lists, components(links))
            last = turn == LEADER_ROUNDS or idle or work.first()[0] <= FEW_PAIRS * size
            these = stored(_with_before(these) if last else these, "lists-apart")
        outside = these if turn == 0 else these.filter("comp <> main")
        if last:
            pairs = _band_pairs(outside, these, k).unionByName(_band_pairs(these.filter("comp = main"), outside, k))
        else:
            # The member with the fewest values of its own comes first: what others were copied from, if it is there.
            lead = outside.groupBy("value").agg(hub.alias("h"), F.min_by("comp", F.struct(F.least("n", F.lit(k)) - F.col("left"), "c", "n", "left")).alias("comp"))
            lead = lead.select("value", F.col("h.c").alias("c2"), F.col("h.n").alias("n2"), F.col("h.left").alias("left2"), F.col("comp").alias("comp2"))
            pairs = these.join(lead, "value").filter((F.col("comp") != F.col("comp2")) & _may_reach(k)).select(F.least("c", "c2").alias("a"), F.greatest("c", "c2").alias("b"))
        pairs = pairs.distinct()
        for old in tested:
            pairs = pairs.join(old, ["a", "b"], "left_anti")
        tested.append(stored(pairs, "pairs"))
        idle = not tested[-1].limit(1).count()
        if not idle:
            new = stored(_confirmed(docs, sketches, tested[-1], shingle, k), "pair-links")
            links, idle = links.unionByName(new), not new.limit(1).count()
        if inside is not None:
            dropped(inside)
        inside = these if turn else None
        if last:
            break
    dropped(active, sketches, lists, *tested, *([inside] if inside is not None else []))
    return links


def _apart(lists: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lists with members of several components: each with its component and the list's main one; and the pairs left to look at.

    Members of one component need no pair, and of two members of different ones at least one is outside of the main.
    """
    named = lists.join(found.select(F.col("node").alias("c"), "component"), "c", "left").withColumn("comp", F.coalesce("component", "c")).drop("component")
    parts = named.groupBy("value", "comp").agg(F.count(F.lit(1)).alias("m"))
    several = parts.groupBy("value").agg(F.sum("m").alias("m"), F.max(F.struct("m", "comp")).alias("main"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    several = stored(several.select("value", "m", F.col("main.comp").alias("main"), F.col("main.m").alias("most")), "lists-parts")
    return named.join(several.select("value", "main"), "value"), several.agg(F.coalesce(F.sum(F.col("m") * (F.col("m") - F.col("most"))), F.lit(0)))


def _confirmed(docs: DataFrame, sketches: DataFrame, pairs: DataFrame, shingle: int, k: int) -> DataFrame:
    """Pairs whose sets are similar enough: by whole sketches, or by the union sketch and then the full sets."""
    side = lambda x, i: sketches.select(F.col("c").alias(x), F.col("sketch").alias(f"s{i}"), F.col("n").alias(f"n{i}"))
    near = pairs.join(side("a", 1), "a").join(side("b", 2), "b")
    enough = lambda both: both * 100 >= (F.col("n1") + F.col("n2") - both) * PERCENT
    # Sketches are in unsigned order; flipping the sign bit gives the same order to signed numbers.
    flip = lambda s: F.transform(s, lambda x: x.bitwiseXOR(F.lit(-(1 << 63))))
    union = F.slice(F.array_sort(F.array_union(flip("s1"), flip("s2"))), 1, k)
    common = F.size(F.array_intersect(union, flip(F.array_intersect("s1", "s2"))))
    small = F.greatest("n1", "n2") <= k
    near = stored(near.filter(F.when(small, enough(F.size(F.array_intersect("s1", "s2")))).otherwise(common >= least_shared(k))).select("a", "b", "n1", "n2"), "near")
    large = near.filter(~small)
    wanted = large.select(F.col("a").alias("c")).unionByName(large.select(F.col("b").alias("c"))).distinct().join(sketches.select("c", "class", "id"), "c")
    sets = stored(_sets(docs, wanted, shingle), "sets")
    full = large.join(sets.select(F.col("c").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("c").alias("b"), F.col("set").alias("y")), "b")
    full = full.filter(enough(F.size(F.array_intersect("x", "y"))))
    return near.filter(small).select("a", "b").unionByName(full.select("a", "b"))
