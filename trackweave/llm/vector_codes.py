"""Vector code compression (operator 12): product quantisation in exact integers.

Components become integers, vectors are cut into parts, and each part position has a codebook that
starts from the first vectors. A round broadcasts the codebooks; Arrow batches find each part's
nearest entry by norm expansion (``|x|^2 - 2 x.c + |c|^2``, int64 matrix products, first argmin);
tasks add up their parts by entry, and a grouped shuffle merges those sums. All is exact, so the
codes depend neither on the order of the rows nor on how they are dealt to tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.llm.scratch import lean, small_batches, stored
from trackweave.session import reach_workers

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Labels that are broadcast at most with their summed errors; beyond, the join shuffles.
BROADCAST_LABELS = 100_000


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & F.coalesce(~F.exists(vector, odd), F.lit(False))


def integers(vectors: pa.Array, dim: int, scale: int) -> np.ndarray:
    """Vectors of ``dim`` components as rows of int64: ``floor(scale * x)``."""
    x = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale).reshape(-1, dim)
    most = isqrt((1 << 62) // (4 * max(dim, 1)))
    if x.size and np.abs(x).max() > most:
        raise ValueError(f"components beyond {most / scale:g} don't fit exact 64-bit distances of {dim} dimensions")
    return x.astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row its nearest entry (the first of several) and the squared distance to it."""
    far = (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)[None, :]
    at = far.argmin(1)
    return at, far[np.arange(len(x)), at]


def _sums(books: Callable[[], np.ndarray], scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's parts added up by codebook and entry: as many rows at most as there are entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = books()
        parts, entries, width = c.shape
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for b in batches:
            x = integers(b.column("vector"), parts * width, scale)
            for p in range(parts):
                own = x[:, p * width : (p + 1) * width]
                at, _ = nearest(own, c[p])
                np.add.at(count[p], at, 1)
                np.add.at(total[p], at, own)
        part, entry = np.nonzero(count)
        sums = pa.array(list(total[part, entry]), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), sums], ["part", "entry", "count", "sums"])

    return run


def _codes(books: Callable[[], np.ndarray], scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each vector's code, two hex digits a part, and its squared distances summed over the parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = books()
        parts, _, width = c.shape
        for b in batches:
            x = integers(b.column("vector"), parts * width, scale)
            at, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                at[:, p], far = nearest(x[:, p * width : (p + 1) * width], c[p])
                error += far
            code = pa.array([row.tobytes().hex() for row in at], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), code, pa.array(error)], ["id", "label", "code", "error"])

    return run


def compress(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> DataFrame:
    """Codes of all vectors, one row each: the id, ``code``, ``error``, ``label_error``, ``codebooks_sha256``.

    Codebooks start as the parts of the ``entries`` vectors of the least ids (ties: the lesser vector;
    null ids last), at most 256. A round replaces each entry by the componentwise ``floor(sum / count)``
    of its parts; unused ones stay. ``label_error`` adds up the errors of equal labels, nulls together.
    The driver holds the codebooks only: ``parts * entries`` rows.

    Defined cases: null vectors and those with null or non-finite components are dropped; fewer vectors
    than entries make smaller codebooks; rows that repeat an id each have a code; vectors of another
    length than that of the least id have null codes and errors; a length that ``parts`` doesn't divide,
    or components too large for exact 64-bit distances, raise ValueError; an empty table gives no rows;
    other columns are ignored.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    spark = vectors.sparkSession
    reach_workers(spark)
    small_batches(spark)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector")).filter(finite(F.col("vector")))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
    order = [F.col("id").asc_nulls_last(), F.col("vector")]
    least = rows.orderBy(*order).select(F.size("vector")).first()
    dim = least[0] if least else 0
    if dim % parts:
        raise ValueError(f"{dim} components can't be cut into {parts} equal parts")
    fit = rows.filter(F.size("vector") == dim)
    start = fit.orderBy(*order).limit(entries).select("vector").collect()
    first = integers(pa.array([r[0] for r in start], pa.list_(pa.float64())), dim, scale) if start else np.zeros((0, dim), np.int64)
    books = np.ascontiguousarray(first.reshape(len(first), parts, dim // parts).transpose(1, 0, 2))
    total = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dim // parts)]
    for _ in range(rounds if len(first) else 0):
        sent = spark.sparkContext.broadcast(books)
        sums = fit.select("vector").mapInArrow(lean(_sums(lambda s=sent: s.value, scale)), "part int, entry int, count bigint, sums array<bigint>")
        books = books.copy()
        for r in sums.groupBy("part", "entry").agg(F.sum("count").alias("count"), *total).collect():  # parts * entries rows at most
            books[r["part"], r["entry"]] = [r[f"s{i}"] // r["count"] for i in range(dim // parts)]
        sent.unpersist()
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    sent = spark.sparkContext.broadcast(books)
    codes = fit.mapInArrow(lean(_codes(lambda: sent.value, scale)), f"id {kinds['id']}, label {kinds['label']}, code string, error bigint")
    other = rows.filter(F.size("vector") != dim).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    codes = stored(codes.unionByName(other), "codes")
    errors = codes.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    few = errors.count() <= BROADCAST_LABELS
    out = codes.join(F.broadcast(errors) if few else errors, codes["label"].eqNullSafe(F.col("__label")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
