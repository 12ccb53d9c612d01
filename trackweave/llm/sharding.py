"""Sharding by k-d tree partitioning over metadata (operator 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackweave.llm.scratch import stored

SHARDS = 40
ROW_BYTES = 16
#: A row's place along a dimension: 22 bits of its value, 20 of its text's hash, 20 of its own.
VALUE_BITS, TEXT_BITS, ROW_BITS = 22, 20, 20
#: Each pass over the metadata splits a node's range in so many bits.
PASS_BITS = 11
#: A cut is fine enough if the range around it holds this share of a shard's bytes.
TOLERANCE = 0.0005
#: Groups of equal texts up to this share of a shard's bytes stay in one shard; larger ones are cut like other rows.
WHOLE_SHARE = 0.05
#: Rows that are numbered by one task.
RUN_ROWS = 20_000


def _scaled(docs: DataFrame, dims: list[str]) -> dict[str, Column]:
    """Values from 0 to 1: numbers by range, others by a hash (null is 0)."""
    kinds = dict(docs.dtypes)
    numbers = [d for d in dims if kinds[d] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[d].startswith("decimal")]
    clean = {d: F.when(F.abs(F.col(d).cast("double")) < float("inf"), F.col(d).cast("double")) for d in numbers}
    ends = docs.agg(*[f(c).alias(f"{f.__name__}_{d}") for d, c in clean.items() for f in (F.min, F.max)]).first() if numbers else {}
    out = {}
    for d in dims:
        if d in numbers:
            lo, hi = ends[f"min_{d}"] or 0.0, ends[f"max_{d}"] or 0.0
            out[d] = F.coalesce((clean[d] - lo) / (hi - lo) if hi > lo else F.lit(0.0), F.lit(0.0))
        else:
            out[d] = F.coalesce(F.pmod(F.xxhash64(F.col(d).cast("string")), F.lit(1 << 30)) / float(1 << 30), F.lit(0.0)) * F.col(d).isNotNull().cast("double")
    return out


def _looked_up(table: dict[int, object], key: str, kind: str) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for k, x in table.items() for v in (k, x)]), F.col(key)).cast(kind)


def shard(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, ...] = ("n_chars", "lang", "source"), shards: int = SHARDS,
) -> DataFrame:
    """Deal rows to ``shards`` shards of near equal bytes; one row for each input row.

    Columns: the id, ``size`` (the text's UTF-8 bytes plus 16), ``text_crc32``, ``law`` (always
    ``bytes``), ``shard``, ``slot`` (gapless from 0 in each shard) and ``grown_shard`` (null).

    A k-d tree: each node is cut along the dimension of ``dims`` in which its bytes spread the
    widest, at the weighted quantile that gives both sides bytes in proportion to their shards.
    Quantiles come from histograms of bytes, refined in passes; the driver sees a bounded table for
    each. Equal texts share their group's least place in each dimension, and rows of one value are
    cut by their text's hash, so a group stays in one shard, unless its bytes are more than
    ``WHOLE_SHARE`` of a shard: then a hash of the id cuts it, so that no hot value or copy makes
    a shard larger. Shards depend on the rows, not on the order in which they come; only rows of
    one id and text that such a cut parts are told apart by their order.

    Defined cases: null texts have no bytes and the CRC of the empty text; null ids are ids like
    others; null, NaN and infinite values of a dimension count as 0; repeated rows each get a slot; an empty table gives none; dimensions
    that the table lacks are left out, other columns are ignored; with fewer rows than shards some shards stay empty.
    """
    dims = [d for d in dims if d in docs.columns]
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    scaled = _scaled(docs, dims) or {"none": F.lit(0.0)}
    base = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"), F.crc32(text).alias("crc"),
        F.monotonically_increasing_id().alias("row"), F.xxhash64(text).alias("th"), *[c.alias(f"x{i}") for i, c in enumerate(scaled.values())],
    )
    rows = stored(base, "shard-rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    xs = [f"x{i}" for i in range(len(scaled))]
    groups = rows.groupBy("th").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), *[F.min(x).alias(f"g{x}") for x in xs])
    groups = groups.filter((F.col("n") > 1) & (F.col("bytes") <= WHOLE_SHARE * total / shards)).drop("n", "bytes")
    whole, apart = F.col(f"g{xs[0]}").isNotNull(), F.pmod(F.xxhash64("id"), F.lit(1 << (ROW_BITS - 8))) * 256 + F.pmod(F.xxhash64("row"), F.lit(256))
    rows = rows.join(groups, "th", "left").select(
        "id", "size", "crc", "row", F.pmod("th", F.lit(1 << TEXT_BITS)).alias("text_part"), F.when(whole, F.lit(0)).otherwise(apart).cast("bigint").alias("row_part"),
        *[F.coalesce(f"g{x}", x).alias(x) for x in xs], F.lit(0).alias("node"),
    )
    rows = stored(rows, "shard-rows")
    nodes = {0: shards}  # first shard of each node, and its number of shards
    while any(n > 1 for n in nodes.values()):
        cut = {lo: n for lo, n in nodes.items() if n > 1}
        spread = [F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("size") * F.col(f"x{i}") ** 2) / F.sum("size") - (F.sum(F.col("size") * F.col(f"x{i}")) / F.sum("size")) ** 2)) for i in range(len(scaled))]
        stats = rows.groupBy("node").agg(F.sum("size").alias("bytes"), *[s.alias(f"s{i}") for i, s in enumerate(spread)]).collect()
        dim = {r["node"]: max(range(len(scaled)), key=lambda i, r=r: (r[f"s{i}"], -i)) for r in stats}
        goal = {r["node"]: r["bytes"] * (cut[r["node"]] // 2) / cut[r["node"]] for r in stats if r["node"] in cut}
        value = F.element_at(F.array(*[F.col(f"x{i}") for i in range(len(scaled))]), _looked_up({lo: dim.get(lo, 0) + 1 for lo in nodes}, "node", "int"))
        place = F.shiftleft(F.least(F.floor(value * (1 << VALUE_BITS)), F.lit((1 << VALUE_BITS) - 1)), TEXT_BITS + ROW_BITS).bitwiseOR(F.shiftleft(F.col("text_part"), ROW_BITS)).bitwiseOR(F.col("row_part"))
        start, before, last, width = dict.fromkeys(goal, 0), dict.fromkeys(goal, 0), dict.fromkeys(goal, 0), VALUE_BITS + TEXT_BITS + ROW_BITS
        while width:
            step = min(PASS_BITS, width)
            width -= step
            part = F.shiftright(F.col("place") - F.col("start"), width)
            known = rows.filter(F.col("node").isin(list(goal))).select("node", "size", place.alias("place"), _looked_up(start or {0: 0}, "node", "bigint").alias("start"))
            bins = known.withColumn("part", part).filter(F.col("part").between(0, (1 << step) - 1)).groupBy("node", "part").agg(F.sum("size").alias("bytes")).collect() if goal else []
            fine = True
            for lo in goal:
                own = sorted((r["part"], r["bytes"]) for r in bins if r["node"] == lo)
                for at, size in own:
                    if before[lo] + size >= goal[lo] or at == own[-1][0]:
                        start[lo] += at << width
                        last[lo] = size
                        fine &= size <= TOLERANCE * total / shards
                        break
                    before[lo] += size
            if fine:
                break
        right = F.col("place") >= F.col("cut")
        # the last range goes to the side that leaves the cut nearer to its goal
        ends = {lo: start.get(lo, 0) + ((1 << width) if lo in goal and goal[lo] - before[lo] >= last[lo] / 2 else 0) for lo in nodes}
        moved = rows.withColumns({"place": place, "cut": _looked_up(ends, "node", "bigint"), "half": _looked_up({lo: n // 2 for lo, n in nodes.items()}, "node", "int")})
        rows = stored(moved.withColumn("node", F.when((F.col("half") > 0) & right, F.col("node") + F.col("half")).otherwise(F.col("node"))).drop("place", "cut", "half"), "shard-rows")
        nodes = dict(sorted([(lo, n // 2 or 1) for lo, n in nodes.items()] + [(lo + n // 2, n - n // 2) for lo, n in cut.items()]))
    return _slots(rows, id_col)


def _slots(rows: DataFrame, id_col: str) -> DataFrame:
    """Number the rows of each shard: runs of rows are numbered by themselves and laid end to end."""
    runs = max(1, rows.count() // RUN_ROWS)
    rows = rows.withColumn("run", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(runs)))
    sizes = rows.groupBy("node", "run").agg(F.count(F.lit(1)).alias("n"))
    until = Window.partitionBy("node").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("node", "run", F.coalesce(F.sum("n").over(until), F.lit(0)).alias("offset"))
    number = F.row_number().over(Window.partitionBy("node", "run").orderBy("row"))
    return rows.withColumn("k", number).join(offsets, ["node", "run"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("node").alias("shard"), (F.col("offset") + F.col("k") - 1).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
