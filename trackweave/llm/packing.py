"""Packing of token sequences by best-fit decreasing (operator 9)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from struct import pack as to_bytes

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm import token_memo
from trackweave.llm.scratch import lean, small_batches, stored
from trackweave.session import reach_workers

WINDOW = 4096
END_ID = 2
#: Pieces of a bucket on average. A bucket is packed by one task, and buckets are all packed alike.
BUCKET_PIECES = 2048
#: Documents of which a task holds the ids at a time.
BATCH_ROWS = 500


class BestFit:
    """Open windows by remaining capacity: a segment tree counts those in each range of capacities."""

    def __init__(self, window: int):
        self.window, self.leaves = window, 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]
        self.windows = 0

    def _add(self, capacity: int, n: int) -> None:
        i = self.leaves + capacity
        while i:
            self.count[i] += n
            i >>= 1

    def _tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` that an open window has."""
        count, i = self.count, self.leaves + least
        if count[i]:
            return least
        while i > 1:
            if not i & 1 and count[i + 1]:  # the range to the right has one: go down to its first
                i += 1
                while i < self.leaves:
                    i = 2 * i if count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None

    def put(self, length: int) -> tuple[int, int]:
        """Window and offset of the next piece; pieces come in decreasing length."""
        capacity = self._tightest(length)
        if capacity is None:
            at, capacity = self.windows, self.window
            self.windows += 1
        else:
            at = self.open[capacity].pop()
            self._add(capacity, -1)
        if rest := capacity - length:
            self.open[rest].append(at)
            self._add(rest, 1)
        return at, self.window - capacity


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, *, id_col: str, text_col: str, window: int, end_id: int, keep_ids: bool) -> DataFrame:
    """Each document's ids with ``end_id`` behind, cut into full windows and a rest."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, n bigint" + ", ids binary" * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, names = 0, [c.split()[0] for c in schema.split(", ")]
        for whole in batches:
            for first in range(0, whole.num_rows, BATCH_ROWS):
                b, out, at_row = whole.slice(first, BATCH_ROWS), [], []
                for row, text in enumerate(b.column("text")):
                    ids = token_memo.dropped_space_ids(tokenizer_path, text.as_py()) + to_bytes("<I", end_id)
                    for at in range(0, len(ids), 4 * window):
                        piece = ids[at : at + 4 * window]
                        out.append((at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, n, piece))
                        at_row.append(row)
                        n += 1
                columns = [pa.array(c, pa.int64()) for c in list(zip(*out, strict=True))[:5]]
                binary = [pa.array([x[5] for x in out], pa.binary())] if keep_ids else []
                # ids pass as Arrow values: a null id among them changes no other
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at_row, pa.int64())), *columns, *binary], names)

    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(lean(cut), schema)


def pack(
    docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
    end_id: int = END_ID, bucket_pieces: int = BUCKET_PIECES, keep_ids: bool = False,
) -> DataFrame:
    """Pack all documents into sequences of ``window`` tokens; one row for each piece of a document.

    Columns: the id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``,
    ``offset``, and with ``keep_ids`` the piece's ids (unsigned 32-bit, little-endian).

    Documents longer than a window are first cut into full windows; then each bucket of about
    ``bucket_pieces`` pieces, dealt by hash, is packed by itself: the longest piece first, into the
    open window with the least room that holds it. Only the pieces' lengths are shuffled (and ids,
    with ``keep_ids``), and a bucket's size doesn't depend on ids or texts that repeat.

    Defined cases: a null or empty text has one token, ``end_id``; repeated rows and ids each get
    their pieces; an empty table gives none; other columns are ignored.
    """
    reach_workers(docs.sparkSession)
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    pieces = stored(tokenized_pieces(docs, tokenizer_path, id_col=id_col, text_col=text_col, window=window, end_id=end_id, keep_ids=keep_ids), "pieces")
    buckets = max(1, round(pieces.count() / bucket_pieces))

    def fill(b: pa.Table) -> pa.Table:
        order = [("length", "descending"), *((c, "ascending") for c in ("id", "start", "ids_crc32", "n"))]
        b = b.take(pc.sort_indices(b, sort_keys=order))
        fit, bucket = BestFit(window), b.column("bucket")[0].as_py()
        placed = [fit.put(n) for n in b.column("length").to_pylist()]
        b = b.append_column("sequence_id", pa.array([(bucket << 24) + w for w, _ in placed], pa.int64()))
        return b.append_column("offset", pa.array([o for _, o in placed], pa.int64())).drop_columns(["bucket", "n"])

    schema = f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids binary" * keep_ids + ", sequence_id bigint, offset bigint"
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "start", "ids_crc32", "n"), F.lit(buckets)).cast("bigint"))
    return dealt.groupBy("bucket").applyInArrow(fill, schema).withColumnRenamed("id", id_col)
