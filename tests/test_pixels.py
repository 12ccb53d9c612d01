"""Extreme pixels are found in tasks, some ellipses at a time."""

import numpy as np

import __spark_entry__ as entry
from trackweave.operators import kernels


def test_extreme_pixels_in_any_slices(monkeypatch):
    r = np.random.default_rng(3)
    x, y, major, minor, theta = r.uniform(0, 90, 40), r.uniform(0, 90, 40), r.uniform(0.2, 9, 40), r.uniform(0.1, 3, 40), r.uniform(0, np.pi, 40)
    whole = [c.tolist() for c in kernels.extreme_pixels(x, y, major, minor, theta)]
    monkeypatch.setattr(kernels, "PIXELS", 50)
    assert whole[0] and whole == [c.tolist() for c in kernels.extreme_pixels(x, y, major, minor, theta)]
    assert [c.tolist() for c in kernels.extreme_pixels(*[np.empty(0)] * 5)] == [[]] * 5


def test_extreme_pixels_shuffle_nothing(spark):
    plan = entry.queries()["extreme_pixels"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "explode" not in plan
