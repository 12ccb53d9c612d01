"""Winnowing over word k-grams, written with DataFrame functions only.

Every window of ``w`` consecutive k-gram hashes keeps its minimum, the rightmost one on ties.
Two texts that share ``k + w - 1`` consecutive words therefore share a kept hash inside that span.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A packed fingerprint: hash above, position below, turned round so that ``least`` prefers the right.
POSITION_BITS = 28
LAST_POSITION = (1 << POSITION_BITS) - 1


def _spread(df: DataFrame, name: str, span: int, join: Callable[[Column, Column], Column]) -> DataFrame:
    """Replace array ``name`` by the fold of ``join`` over each ``span`` neighbours, doubling the reach."""
    reach = 1
    while reach < span:
        step = min(reach, span - reach)
        left = F.greatest(F.size(name) - step, F.lit(0))
        df = df.withColumn(name, F.zip_with(F.slice(name, 1, left), F.slice(name, F.lit(1 + step), left), join))
        reach += step
    return df


def fingerprints(df: DataFrame, words: str, out: str, k: int, w: int, *, short: bool) -> DataFrame:
    """Add ``out``: the distinct packed fingerprints of the array column ``words``.

    A text of fewer than ``k`` words has none, unless ``short``: then the whole sequence is one
    k-gram, and a text with fewer than ``w`` k-grams keeps its least one. No words: empty array.
    """
    if k < 1 or w < 1:
        raise ValueError("k and w must be at least 1")
    pack = lambda x, i: F.shiftleft(x, POSITION_BITS).bitwiseOR(F.lit(LAST_POSITION) - i)
    df = df.withColumn(out, F.transform(words, lambda x: F.xxhash64(x)))
    whole = f"{out}__whole"
    if short:
        df = df.withColumn(whole, F.when(F.size(words) > 0, F.array(F.xxhash64(F.col(words)))).otherwise(F.array().cast("array<bigint>")))
    df = _spread(df, out, k, lambda a, b: F.xxhash64(a, b))
    if short:
        df = df.withColumn(out, F.when(F.size(words) < k, F.col(whole)).otherwise(F.col(out))).drop(whole)
    df = df.withColumn(out, F.transform(out, pack))
    if short:
        df = df.withColumn(whole, F.when(F.size(out).between(1, w - 1), F.array(F.array_min(out))).otherwise(F.array().cast("array<bigint>")))
    df = _spread(df, out, w, lambda a, b: F.least(a, b))
    df = df.withColumn(out, F.array_distinct(out))
    if short:
        df = df.withColumn(out, F.concat(out, whole)).drop(whole)
    return df


def position(packed: Column) -> Column:
    """Word position of a packed fingerprint."""
    return F.lit(LAST_POSITION) - packed.bitwiseAND(F.lit(LAST_POSITION))


def hashed(packed: Column) -> Column:
    """Hash of a packed fingerprint."""
    return F.shiftrightunsigned(packed, POSITION_BITS)
