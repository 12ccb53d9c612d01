"""Benchmark decontamination by winnowing (operator 1): DataFrame functions only.

Training and test texts are winnowed with the same parameters, the fingerprints are joined, and
each joined fingerprint is extended to the exact word windows around it. Because ``k + w - 1``
is the window's length, every shared window holds a shared fingerprint, so none is missed.
Arrays are exploded by ``explode_outer``: ``explode`` would add a filter on the array's size, which
the optimizer pushes below the projections and so computes the whole array once more for each step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.llm import winnow
from trackweave.llm.scratch import stored

WINDOW = 10
#: Rows of the benchmark's side that are broadcast at most; beyond, joins shuffle.
BROADCAST_ROWS = 200_000
#: Everything that is no word: ASCII other than digits and lower-case letters.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a text, A-Z in lower case; a null text has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NO_WORD), "")


def scheme(length: int) -> tuple[int, int]:
    """k and w with ``k + w - 1 == length``."""
    k = max(1, min(4, (length + 1) // 2))
    return k, length - k + 1


def _tagged(n: int):
    return lambda x: F.struct(F.lit(n).alias("len"), x.alias("packed"))


def _marks(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Add ``marks``: (len, packed) for the winnowing scheme of each window length."""
    parts = []
    for n in lengths:
        df = winnow.fingerprints(df, "words", f"f{n}", *scheme(n), short=False)
        parts.append(F.transform(f"f{n}", _tagged(n)))
    return df.withColumn("marks", F.concat(*parts)).drop(*(f"f{n}" for n in lengths))


def _windows(df: DataFrame, name: str, n: int) -> DataFrame:
    """Replace the words of array ``name`` by its windows of ``n`` words, joined by spaces, built by doubling."""
    df, reach, size = df.withColumn("__out", F.lit(None).cast("array<string>")).withColumn("__power", F.col(name)), 0, 1
    both = lambda a, b: F.concat(a, F.lit(" "), b)
    rest = lambda c, step: F.slice(c, F.lit(1 + step), F.greatest(F.size(c) - step, F.lit(0)))
    cut = lambda a, b: F.slice(a, F.lit(1), F.size(b))
    while size <= n:
        if n & size:
            df = df.withColumn("__out", F.col("__power") if not reach else F.zip_with(cut("__out", rest("__power", reach)), rest("__power", reach), both))
            reach += size
        df = df.withColumn("__power", F.zip_with(cut("__power", rest("__power", size)), rest("__power", size), both))
        size *= 2
    return df.drop("__power").withColumn(name, F.col("__out")).drop("__out")


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct word windows of the items: ``len``, ``win``, and the sorted ids of the items that hold it."""
    n = F.least(F.lit(window), F.size("words"))
    return (
        items.filter(F.size("words") > 0)
        .withColumn("len", n)
        .withColumn("at", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("len"))))
        .select("len", F.concat_ws(" ", F.slice("words", F.col("at") + 1, F.col("len"))).alias("win"), "item")
        .groupBy("len", "win")
        .agg(F.collect_set("item").alias("items"))
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Find the documents' words inside any occurrence of a window of a benchmark item.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is
    one window. One row for each input row: the id, ``n_words``, ``spans`` (array of start and end
    word, end exclusive, overlapping ones merged) and ``items`` (sorted item ids as strings).

    Defined cases: null or wordless texts have no words and no hits; null item texts have no
    windows; windows of items with a null id count as hits but name no item; repeated rows each
    get a row; an empty benchmark leaves all spans empty; other columns are ignored.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(item_text_col)).alias("words"))
    windows = stored(benchmark_windows(items, window), "bench-windows")
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect())  # as many as window at most
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), words_of(F.col(text_col)).alias("words"))
    own = F.struct(F.lit(0).alias("len"), F.lit(-1).cast("bigint").alias("packed"))
    if not lengths:
        rows = rows.withColumn("marks", F.array(own))
    else:
        rows = _marks(rows, lengths).withColumn("marks", F.concat("marks", F.array(own)))
    test = None
    for n in lengths:
        k, w = scheme(n)
        part = windows.filter(F.col("len") == n).select(F.split("win", " ").alias("words"))
        part = winnow.fingerprints(part, "words", "f", k, w, short=False).select(F.explode_outer("f").alias("packed")).filter("packed IS NOT NULL")
        part = part.select(F.lit(n).alias("len"), winnow.hashed(F.col("packed")).alias("fp"), F.lit(w).alias("w")).distinct()
        test = part if test is None else test.unionByName(part)
    if test is None:
        test = docs.sparkSession.createDataFrame([], "len int, fp bigint, w int")
    test = stored(test, "bench-marks")
    few = lambda df: df.count() <= broadcast_rows
    near = lambda df: F.broadcast(df) if few(df) else df
    # A row's own mark has length 0 and meets no fingerprint: it carries n_words, each under its own hash.
    marks = rows.select("id", "th", F.size("words").alias("n_words"), F.explode_outer("marks").alias("mark")).select(
        "id", "th", "n_words", F.col("mark.len").alias("len"), winnow.position(F.col("mark.packed")).cast("int").alias("at"),
        F.when(F.col("mark.len") == 0, F.col("th")).otherwise(winnow.hashed(F.col("mark.packed"))).alias("fp"),
    )
    met = marks.join(near(test), ["len", "fp"], "left").filter((F.col("len") == 0) | F.col("w").isNotNull())
    met = stored(met.select("id", "th", "n_words", "len", "at", "w"), "met-marks")
    first = F.greatest(F.lit(0), F.col("at") - F.col("w") + 1)
    last = F.least(F.col("at"), F.col("n_words") - F.col("len"))
    spread = met.filter((F.col("len") > 0) & (last >= first)).select("id", "th", "len", F.explode(F.sequence(first, last)).alias("s"))
    starts = stored(spread.groupBy("id", "th", "len").agg(F.array_sort(F.collect_set("s")).alias("starts")), "starts")
    same = lambda x, y: F.col(f"{x}.id").eqNullSafe(F.col(f"{y}.id")) & (F.col(f"{x}.th") == F.col(f"{y}.th"))
    keys = starts.select("id", "th").distinct()
    text = rows.drop("marks").alias("r").join(near(keys).alias("k"), same("r", "k"), "left_semi").dropDuplicates(["id", "th"])
    found = None
    for n in lengths:  # the exact words of each start; a text's windows are made once
        part = text.alias("r").join(starts.filter(F.col("len") == n).alias("s"), same("r", "s")).select("r.id", "r.th", "words", "starts")
        part = _windows(part, "words", n).select("id", "th", F.explode_outer(F.transform("starts", lambda s: F.struct(s.alias("s"), F.get("words", s).alias("win")))).alias("x"))
        part = part.select("id", "th", F.lit(n).alias("len"), "x.s", "x.win")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = starts.select("id", "th", "len", F.lit(0).alias("s"), F.lit("").alias("win")).limit(0)
    hits = found.join(near(windows), ["len", "win"])
    per = hits.groupBy("id", "th").agg(
        F.array_sort(F.collect_set(F.struct(F.col("s").alias("start"), (F.col("s") + F.col("len")).alias("end")))).alias("raw"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    runs = F.aggregate(
        "raw",
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    per = per.select(F.col("id").alias("hid"), F.col("th").alias("hth"), runs.alias("spans"), "items")
    own_rows = met.filter("len = 0").select("id", "th", "n_words")
    return own_rows.join(per, F.col("id").eqNullSafe(F.col("hid")) & (F.col("th") == F.col("hth")), "left").select(
        F.col("id").alias(id_col), "th", F.col("n_words").cast("bigint").alias("n_words"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def decontamination_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row for each document: words, hit words, and a digest of the items that it holds."""
    found = decontaminate(docs, benchmark, **options)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, x: acc + (x["end"] - x["start"]))
    return found.select(
        options.get("id_col", "doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
