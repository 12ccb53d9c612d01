"""Secret scans by corpus-wide ownership frequency (operator 6): DataFrame functions only.

Candidates are known by the digests of their values. How many distinct owners (and repositories) hold a
value, over the whole corpus, tells copied examples from credentials of one owner. Where the boundary lies
is read off the corpus too: for each kind, the split of the values' owner counts that sets the two sides
furthest apart. Candidates of the added kinds that turn out as examples are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackweave.llm.scratch import stored

#: Fixed patterns of the base kinds, in the order of their kinds; Java's flag (?i) folds ASCII letters only.
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12
#: Any sign that a base kind may be there; texts without it aren't cut up.
HINT = r"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{16}"
#: Fixed patterns of the added kinds: a sign to look for first, the pattern, and the group that is the value.
ADDED = {
    "jwt": ("eyJ", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0),
    "pem": ("-----BEGIN", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}+(?:-----END (?:[A-Z]+ ){0,3}PRIVATE KEY-----)?", 0),
    "provider": (r"_|-|AIza", r"(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})", 0),
    "url": ("://", r"\b[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s:/@]{1,64}:([^\s/@]{6,256})@", 1),
    "token": (None, r"[A-Za-z0-9+/_=-]{20,}", 0),
}
KINDS = ("assign", "access", "hex", *ADDED)
#: Runs count as tokens only if they mix digits, upper and lower case.
MIXED = r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])"
#: From so many owners on a value is an example where all values of its kind have as many owners, so the corpus has no boundary.
EXAMPLE_OWNERS = 5
#: Matches that are laid together at a time, so that many in one text take time in proportion.
TOGETHER = 128
#: Rows of documents with spans that are broadcast at most when texts are redacted.
BROADCAST_ROWS = 100_000
REDACTED = "[SECRET]"

SPAN = "struct<start:int,rank:int,end:int,value:string>"


def _spans(text: Column, rank: int, pattern: str, group: int = 0) -> Column:
    """All leftmost non-overlapping matches as (start, rank, end, value), in code points.

    The pieces between the matches and the matches themselves give the positions.
    """
    between = F.split(text, pattern, -1)
    whole, value = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    hits = F.arrays_zip(F.slice(between, F.lit(1), F.size(whole)).alias("b"), whole.alias("w"), value.alias("v"))
    none = F.array().cast(f"array<{SPAN}>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["b"])
        end = start + F.length(x["w"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), x["v"].alias("value")))).alias("out"))

    def chunk(acc: Column, some: Column) -> Column:
        inner = F.aggregate(some, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return F.struct(inner["at"].alias("at"), F.concat(acc["out"], F.array(inner["out"])).alias("out"))

    return F.aggregate(_chunked(hits), F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("out")), chunk, lambda acc: F.flatten(acc["out"]))


def _chunked(array: Column) -> Column:
    """An array's elements, ``TOGETHER`` at a time."""
    first = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(array) - 1), F.lit(TOGETHER)), lambda i: i < F.size(array))
    return F.transform(first, lambda i: F.slice(array, i + 1, F.lit(TOGETHER)))


def _named(docs: DataFrame, column: str | None) -> Column | None:
    return F.coalesce(F.col(column).cast("string"), F.lit("")) if column and column in docs.columns else None


def detect(docs: DataFrame, id_col: str, text_col: str, owner_col: str | None, repo_col: str | None = None) -> DataFrame:
    """Each row's ``id``, ``th`` (hash of its text), ``owner``, ``repo``, ``base`` spans and ``more`` candidates."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast(f"array<{SPAN}>")
    owner, repo = _named(docs, owner_col), _named(docs, repo_col)
    owner = F.lit("") if owner is None else owner
    repo = F.xxhash64(F.col(id_col), text).cast("string") if repo is None else repo
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), owner.alias("owner"), repo.alias("repo"), text.alias("text"))
    assign = F.filter(_spans(F.col("text"), 0, ASSIGN, 1), lambda x: F.length(x["value"]) >= ASSIGN_LEAST)
    base = F.array_sort(F.concat(assign, _spans(F.col("text"), 1, ACCESS), _spans(F.col("text"), 2, HEX)))
    rows = rows.withColumn("base", F.when(F.col("text").rlike(HINT), base).otherwise(none))
    for rank, (name, (sign, pattern, group)) in enumerate(ADDED.items(), 3):
        there = F.col("text").rlike(pattern) if sign is None else F.col("text").rlike(sign) & F.col("text").rlike(pattern)
        rows = rows.withColumn(name, F.when(there, _spans(F.col("text"), rank, pattern, group)).otherwise(none))
    rows = rows.withColumn("token", F.filter("token", lambda x: x["value"].rlike(MIXED)))
    rows = rows.withColumn("more", F.array_sort(F.concat(*ADDED))).drop("text", *ADDED)
    # From here on a value is known by its digest only: no credential is written or shuffled.
    keyed = lambda c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), F.sha2(x["value"], 256).alias("key")))
    rows = rows.withColumns({"base": keyed("base"), "more": keyed("more")})
    # A candidate that overlaps a base span is that; of two added ones the kind listed first stays.
    meets = lambda x, b: (b["start"] < x["end"]) & (x["start"] < b["end"])
    rows = rows.withColumn("more", F.filter("more", lambda x: ~F.exists("base", lambda b: meets(x, b))))
    known = F.filter("more", lambda x: x["rank"] < len(KINDS) - 1)
    rows = rows.withColumn("known", known).withColumn("more", F.filter("more", lambda x: (x["rank"] < len(KINDS) - 1) | ~F.exists("known", lambda b: meets(x, b))))
    return rows.drop("known")


def boundaries(owned: DataFrame) -> DataFrame:
    """From how many owners on a value of a kind is an example: ``rank``, ``least``.

    ``owned``: distinct values (``rank``, ``owners``). Of all ways to cut a kind's values by their (logarithmic)
    owner counts, the one with the largest variance between the sides; ties: the lower. A kind whose values all
    have as many owners has none, and ``EXAMPLE_OWNERS`` stands in. The windows run over counts of counts, one row for each number of owners.
    """
    counts = owned.groupBy("rank", "owners").agg(F.count(F.lit(1)).alias("n")).withColumn("x", F.log2("owners") * F.col("n"))
    w = Window.partitionBy("rank")
    below = w.orderBy("owners").rowsBetween(Window.unboundedPreceding, -1)
    c = counts.withColumns({"n0": F.sum("n").over(below), "x0": F.sum("x").over(below), "n1": F.sum("n").over(w), "x1": F.sum("x").over(w)}).filter("n0 IS NOT NULL AND owners > 1")
    left, right = F.col("x0") / F.col("n0"), (F.col("x1") - F.col("x0")) / (F.col("n1") - F.col("n0"))
    apart = F.round(F.col("n0") * (F.col("n1") - F.col("n0")) * (left - right) ** 2, 9)
    return c.groupBy("rank").agg(F.min(F.struct((-apart).alias("apart"), "owners")).alias("b")).select("rank", F.col("b.owners").alias("least"))


def scan(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str | None = "source", repo_col: str | None = None, example_owners: int | None = None,
) -> DataFrame:
    """Find credentials; one row for each input row: the id, ``th``, and ``spans``.

    A span has ``start``, ``rank`` (place in KINDS), ``end`` (code points, end exclusive),
    ``key`` (SHA-256 of the value), ``owners`` and ``repos`` (distinct ones over the corpus that
    hold the value), and ``example``: whether so many owners hold it that it is a copied example:
    ``example_owners``, or if that is None the boundary that the corpus itself has for the kind
    (``boundaries``). All base spans stay; of the added kinds only those that are no examples do.
    Without ``repo_col`` each document is a repository of its own.

    Defined cases: a null text is empty; null owners are one owner, as all are if the column is
    missing; rows with a null id have spans as well, and are one repository for each text;
    repeated rows each get a row; an empty table gives none; other columns are ignored.
    """
    found = stored(detect(docs, id_col, text_col, owner_col, repo_col), "secrets")
    each = found.select("id", "th", "owner", "repo", F.explode(F.concat("base", "more")).alias("x")).select("id", "th", "owner", "repo", "x.*")
    # Copies of a value within an owner and repository are put together before the value's rows meet.
    repos = each.groupBy("key", "owner", "repo").agg(F.min("rank").alias("rank"))
    owners = repos.groupBy("key", "owner").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("rank"))
    owned = owners.groupBy("key").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repos"), F.min("rank").alias("of"))
    if example_owners is None:
        owned = stored(owned, "owned")
        least = boundaries(owned.select(F.col("of").alias("rank"), "owners")).withColumnRenamed("rank", "of")
        owned = owned.join(F.broadcast(least), "of", "left").fillna(EXAMPLE_OWNERS, "least")  # a row for each kind
    else:
        owned = owned.withColumn("least", F.lit(example_owners))
    owned = owned.select("key", "owners", "repos", (F.col("owners") >= F.col("least")).alias("example"))
    spans = each.select("id", "th", "start", "rank", "end", "key").distinct().join(owned, "key")
    spans = spans.filter((F.col("rank") < 3) | ~F.col("example"))
    per = spans.groupBy("id", "th").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "key", "owners", "repos", "example"))).alias("spans"))
    per = per.select(F.col("id").alias("hid"), F.col("th").alias("hth"), "spans")
    rows = found.select("id", "th").join(per, F.col("id").eqNullSafe(F.col("hid")) & (F.col("th") == F.col("hth")), "left")
    kind = per.schema["spans"].dataType.simpleString()
    return rows.select(F.col("id").alias(id_col), "th", F.coalesce("spans", F.array().cast(kind)).alias("spans"))


def scan_report(docs: DataFrame, **options) -> DataFrame:
    """Counts by kind and digests of the spans, one row for each document."""
    rows = scan(docs, **options)
    name = lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["rank"] + 1), x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("spans", lambda x: x["rank"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda x: x["rank"] == k)).cast("bigint")
    return rows.select(
        options.get("id_col", "doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(F.array_join(F.transform(base, name), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", name), ",").alias("spans"),
        F.size(F.filter("spans", lambda x: ~x["example"])).cast("bigint").alias("n_live"),
    )


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Put ``[SECRET]`` in place of all spans that are no examples; rows and columns stay.

    A null text stays null; overlapping spans are replaced as one; repeated rows and rows without
    an id are each redacted; an empty table gives none; other columns may have any names.
    """
    found = scan(docs, id_col=id_col, text_col=text_col, **options)
    live = found.select(F.col(id_col).alias("__id"), F.col("th").alias("__th"), F.filter("spans", lambda x: ~x["example"]).alias("__spans")).filter(F.size("__spans") > 0)
    live = stored(live.dropDuplicates(["__id", "__th"]), "live")
    if live.count() <= BROADCAST_ROWS:
        live = F.broadcast(live)
    text = F.col(f"d.{text_col}")

    def chunk(acc: Column, some: Column) -> Column:
        # the chunk's stretch of the text is cut out once, and its gaps from that
        base, last = acc["at"], F.greatest(acc["at"], F.array_max(F.transform(some, lambda x: x["end"])))
        part = F.substring(text, base + 1, last - base)

        def step(inner: Column, x: Column) -> Column:
            gap = F.substring(inner["part"], inner["at"] - inner["base"] + 1, x["start"] - inner["at"])
            out = F.when(x["start"] >= inner["at"], F.concat(inner["out"], gap, F.lit(REDACTED))).otherwise(inner["out"])
            return F.struct(F.greatest(inner["at"], x["end"]).alias("at"), out.alias("out"), inner["part"].alias("part"), inner["base"].alias("base"))

        got = F.aggregate(some, F.struct(base.alias("at"), F.lit("").alias("out"), part.alias("part"), base.alias("base")), step)
        return F.struct(got["at"].alias("at"), F.concat(acc["out"], F.array(got["out"])).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate(_chunked(F.col("l.__spans")), start, chunk, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    same = F.col(f"d.{id_col}").eqNullSafe(F.col("l.__id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("l.__th"))
    joined = docs.alias("d").join(live.alias("l"), same, "left")
    return joined.select(*[F.when(F.col("l.__spans").isNotNull(), clean).otherwise(text).alias(c) if c == text_col else F.col(f"d.`{c}`") for c in docs.columns])
