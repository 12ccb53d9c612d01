"""Near-duplicates: the banded join of inverted lists finds all pairs that may reach the overlap, and joins no others of a template."""

import random

import pytest
from pyspark.sql import functions as F

from trackweave.llm import near_dup as N

ENTRY = "value long, c long, n int, left int, comp long, main long"


@pytest.mark.parametrize("k", [64, 512])
def test_bands_hold_all_admissible_pairs(spark, k):
    rng = random.Random(k)
    rows = []
    for c in range(400):
        n = rng.choice([rng.randrange(1, 30), rng.randrange(40, 90), rng.randrange(300, 900)])
        held = min(n, k)
        rows.append((rng.randrange(3), c, n, rng.randrange(max(1, int(held * 0.6)), held + 1), rng.choice([c, c, 7]), 7))
    e = spark.createDataFrame(rows, ENTRY)
    other = e.select("value", F.col("c").alias("c2"), F.col("n").alias("n2"), F.col("left").alias("left2"), F.col("comp").alias("comp2"))
    want = e.join(other, "value").filter((F.col("c") < F.col("c2")) & (F.col("comp") != F.col("comp2")) & N._may_reach(k)).select("c", "c2")
    outside = e.filter("comp <> main")
    got = N._band_pairs(outside, e, k).unionByName(N._band_pairs(e.filter("comp = main"), outside, k))
    got, want = sorted(map(tuple, got.collect())), sorted(map(tuple, want.collect()))
    assert len(want) > 500 and sorted(set(got)) == want


def test_a_template_makes_no_pairs_to_refuse(spark):
    """Sets of 100 with 80 in common: none can reach 75 %, so no band holds both sides."""
    e = spark.createDataFrame([(v, c, 100, 80 - v, c, 0) for v in range(6) for c in range(1, 300)], ENTRY)
    small, large = N._banded(e, 512, False), N._banded(e, 512, True)
    assert small.count() == 0 and large.count() <= (N.BANDS + 2) * e.count()
    assert N._band_pairs(e, e, 512).count() == 0


def test_template_documents_stay_apart(spark):
    rng = random.Random(2)
    base = [f"t{i}" for i in range(84)]
    own = lambda i: [f"u{i}x{j}" for j in range(20)]
    rows = [(i, " ".join(base + own(i))) for i in range(300)] + [(1000 + i, " ".join([*base, *own(i)[:-1]])) for i in range(0, 300, 50)]
    rng.shuffle(rows)
    got = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(300)} | {1000 + i: i for i in range(0, 300, 50)}


def test_pipeline_leaves_its_result_only(spark, tmp_path, monkeypatch):
    import os

    import corpus_pipeline
    from trackweave.llm import scratch

    for module in (scratch, corpus_pipeline):
        monkeypatch.setattr(module, "shared_dir", lambda _: str(tmp_path))
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    (left,) = os.listdir(tmp_path)
    assert os.listdir(tmp_path / left) == ["4"] and out.count() > 0
    with pytest.raises(ZeroDivisionError), scratch.cleared(spark):
        scratch.stored(spark.range(3), "gone")
        1 / 0  # noqa: B018
    assert os.listdir(tmp_path) == [left]


def test_next_texts_with_many_null_and_repeated_ids(spark, monkeypatch):
    """Half of the ids null, a third of the rest one id: each row's next is the one behind it in the order of ids and texts."""
    from collections import Counter

    from trackweave.llm import fingerprint

    monkeypatch.setattr(fingerprint, "DOCS_PER_BUCKET", 10)
    rng = random.Random(3)
    rows = [(None if i % 2 else 50 if i % 6 == 0 else i, f"t{rng.randrange(1000)}") for i in range(300)]
    got = fingerprint.with_next(spark.createDataFrame(rows, "doc_id int, text string").repartition(5), "doc_id", "text")
    ghosts = got.filter("ghost").groupBy("bucket").count().collect()
    assert len(ghosts) > 5 and all(r["count"] == 1 for r in ghosts)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = Counter((*r, order[(i + 1) % len(order)][1]) for i, r in enumerate(order))
    assert Counter((r["id"], r["text"], r["next_text"]) for r in got.filter("NOT ghost").collect()) == want


def test_copies_with_the_same_changes_make_one_pair(spark):
    """Members of a family that share 30 changed values each make one row, in the first list that holds both, not one in each list."""
    rng = random.Random(5)
    rows = []
    for c in range(60):
        held = sorted(rng.sample(range(60), 30))
        rows += [(v, c, 512, 500 - i, c, -1) for i, v in enumerate(held)]
    e = spark.createDataFrame(rows, ENTRY)
    every = N._band_pairs(e, e, 512)
    once = N._band_pairs(N._with_before(e), N._with_before(e), 512)
    want = set(map(tuple, every.collect()))
    assert len(want) == 60 * 59 // 2 and every.count() > 5 * len(want)
    got = list(map(tuple, once.collect()))
    assert set(got) == want and len(got) < 1.05 * len(want)
