"""Corpus operators against brute force, and their defined cases."""

import hashlib
import random
import unicodedata
from collections import Counter, defaultdict

import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trackweave.llm import chat, decontaminate, fingerprint, langid, license_scan, near_dup, packing, secret_scan, sharding, token_count, token_memo

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
BIG = 9007199254740993  # no double is equal to it
SMALL, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def table(spark, rows, schema="doc_id bigint, text string, lang string, source string, n_chars bigint"):
    return spark.createDataFrame(rows, schema)


def doc(i, text, source="s", lang="en"):
    return (i, text, lang, source, len(text or ""))


# Ids


def test_null_ids_change_no_large_id(spark):
    words = " ".join(f"w{i}" for i in range(30))
    rows = table(spark, [doc(BIG, words), doc(None, words), doc(BIG + 2, words + " end"), doc(7, "other words here")]).coalesce(1)
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(rows).collect()}
    assert set(got) == {BIG, None, BIG + 2, 7} and got[BIG + 2]["component_id"] == BIG and got[None]["component_id"] is None and got[None]["kept"]
    assert {r["doc_id"] for r in packing.pack(rows, WORDS).collect()} == {BIG, None, BIG + 2, 7}
    turns = spark.createDataFrame([(BIG, 0, "user", "hi"), (None, 0, "user", "hi"), (None, 1, "assistant", None)], "conv_id bigint, turn bigint, role string, text string").coalesce(1)
    assert {(r["conv_id"], r["n_turns"]) for r in chat.read_back(chat.formatted_turns(turns)).collect()} == {(BIG, 1), (None, 2)}


# Tokens


def test_letters_that_decompose_have_the_library_ids():
    w, b = Tokenizer.from_file(WORDS), Tokenizer.from_file(BYTES)
    letters = [c for c in map(chr, [*range(0xC0, 0xD800), *range(0xF900, 0x20000, 7)]) if c.isalpha() and (unicodedata.normalize("NFC", c.lower()) != c or ord(c) % 41 == 0)]
    for c in letters:
        for mark in token_memo.MARKS if not unicodedata.normalize("NFC", c.lower()).isalpha() else "!":
            text = f"a{c}{mark} {c}{mark}{mark} b"
            assert token_memo.dropped_space_ids(WORDS, text) == b"".join(i.to_bytes(4, "little") for i in w.encode(text, add_special_tokens=False).ids), (c, mark)
            assert token_memo.byte_level_count(BYTES, text) == len(b.encode(text, add_special_tokens=False).ids), (c, mark)


def test_a_cache_is_read_by_tokenizer_version(spark, tmp_path):
    cache, rows = f"{tmp_path}/cache", table(spark, [doc(1, "one two"), doc(2, "one two"), doc(3, None)]).withColumns({"digest": F.lit("x"), "n_tokens": F.lit(-1)})
    first = token_count.count_tokens(rows, cache, BYTES).collect()
    assert spark.read.parquet(cache).count() == 2
    token_count.count_tokens(rows, cache, WORDS)
    assert spark.read.parquet(cache).select("tokenizer").distinct().count() == 2
    assert sorted(token_count.count_tokens(rows, cache, BYTES).collect()) == sorted(first) and spark.read.parquet(cache).count() == 4


# Near-duplicates


def linked(texts):
    """Component of each text by all pairs: the least place that links reach."""
    sets, up = [], list(range(len(texts)))
    for t in texts:
        raw = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in raw.translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if x]
        n = min(5, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set())
    held = defaultdict(list)

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in enumerate(sets):
        for j, both in Counter(j for v in s for j in held[v]).items():
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                up[b] = a
        for v in s:
            held[v].append(i)
    return [top(i) for i in range(len(texts))], [len(s) for s in sets]


def test_every_link_of_a_whole_table_is_found(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want, sizes = linked([r["text"] for r in rows])
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert len(got) == len(rows) and sum(w != i for i, w in enumerate(want)) > 50
    for r, w, n in zip(rows, want, sizes, strict=True):
        x = got[r["doc_id"]]
        assert (x["component_id"], x["n_shingles"], x["kept"]) == (rows[w]["doc_id"], n, rows[w]["doc_id"] == r["doc_id"])


def test_chains_hot_lists_and_long_texts(spark):
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(60)]
    base = [f"b{i}" for i in range(100)]
    texts = [" ".join([*passage, *(f"u{i}x{j}" for j in range(40))]) for i in range(60)]  # one passage in all, no links
    chain = list(base)
    for step in range(8):  # each is linked to the next, the first isn't to the last
        chain = chain[:]
        chain[step * 12] = f"c{step}"
        texts.append(" ".join(chain))
    for _ in range(60):  # copies of one text that differ from each other more than from it
        x = list(base)
        for k in rng.sample(range(100), rng.randint(1, 3)):
            x[k] = f"r{rng.random()}"
        texts.append(" ".join(x))
    long = " ".join(f"long{i % 5000}q{i}" for i in range(20000))
    texts += [long, long + " tail", "x" * 3_000_000, "x" * 3_000_000 + " y", "", None, "one two", "ONE two"]
    want, _ = linked(texts)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(table(spark, [doc(i, t) for i, t in enumerate(texts)]).withColumn("id", F.lit("clash"))).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert near_dup.near_duplicates(table(spark, [])).count() == 0


# Fingerprints


def spark_hash(value, seed=42):
    raw = value.encode() if isinstance(value, str) else value.to_bytes(8, "little", signed=True)
    h = xxhash.xxh64_intdigest(raw, seed=seed % (1 << 64))
    return h - (1 << 64) if h >> 63 else h


def test_fingerprints_keep_the_least_hash_of_each_window(spark):
    k, w, rng = 4, 3, random.Random(2)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 30))) for _ in range(20)]  # many ties
    pair = lambda a, b: spark_hash(b, spark_hash(a))
    got = [r["fp"] for r in fingerprint.fingerprint(table(spark, [doc(i, t) for i, t in enumerate(texts)]), "text", "fp", k=k, w=w).orderBy("doc_id").collect()]
    for text, fp in zip(texts, got, strict=True):
        words = text.split()
        if len(words) < k:
            assert len(fp) == min(1, len(words))
            continue
        one = [spark_hash(x) for x in words]
        two = [pair(a, b) for a, b in zip(one, one[1:], strict=False)]
        four = [pair(a, b) % (1 << 36) for a, b in zip(two, two[2:], strict=False)]
        signed = lambda h: h - (1 << 36) if h >> 35 else h
        kept = set()
        for i in range(max(1, len(four) - w + 1)):
            least = min(map(signed, four[i : i + w]))
            at = max(j for j in range(i, min(i + w, len(four))) if signed(four[j]) == least)
            kept.add((four[at], at))
        assert {(x["hash"], x["pos"]) for x in fp} == kept, text


def test_equal_and_neighbouring_texts(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [doc(1, long), doc(2, long), doc(3, None), doc(3, ""), doc(5, "short one")]
    got = sorted(fingerprint.edit_report(table(spark, rows)).collect(), key=lambda r: (r["doc_id"], r["n_chars"]))
    assert got[0]["near_next"] == 1 and got[0]["fingerprint"] == got[1]["fingerprint"] and got[1]["near_next"] == 0 and got[2]["near_next"] == 1
    assert fingerprint.edit_report(table(spark, [])).count() == 0


# Decontamination


def test_empty_documents_have_no_hits(spark):
    bench = spark.createDataFrame([("b", "one two three")], "item_id string, text string")
    assert decontaminate.decontamination_report(table(spark, []), bench).count() == 0


# Secrets


def test_ownership_decides_added_spans(spark):
    rng = random.Random(6)
    key = lambda i: "".join(random.Random(i).choices("GHJKLMNPQRghjkmnpqr23456789", k=24)) + "gH3"
    rows = []
    for i in range(300):
        kind = rng.randrange(4)
        text = f"note {key(1 if kind == 0 else 100 + i % 40 if kind == 1 else 1000 + i)} end" if kind < 3 else "password = hunter2hunter2"
        rows.append((i, text, f"o{rng.randrange(12) if kind != 1 else i % 40 % 3}", f"r{i % 7}"))
    docs = spark.createDataFrame([*rows, (None, rows[0][1], None, None), rows[1]], "doc_id bigint, text string, source string, repo string")
    held, repos = defaultdict(set), defaultdict(set)
    for _, t, owner, repo in [*rows, (None, rows[0][1], "", "")]:
        v = t.split()[1] if t.startswith("note") else "hunter2hunter2"
        held[v].add(owner)
        repos[v].add((owner, repo))
    got = secret_scan.scan(docs, repo_col="repo").collect()
    assert len(got) == 302
    by = {r["doc_id"]: r["spans"] for r in got}
    for i, t, _, _ in rows:
        v = t.split()[1] if t.startswith("note") else "hunter2hunter2"
        copied = len(held[v]) >= secret_scan.EXAMPLE_OWNERS
        assert [s["key"] for s in by[i]] == ([] if copied and t.startswith("note") else [hashlib.sha256(v.encode()).hexdigest()])
        assert all((s["owners"], s["repos"], s["example"]) == (len(held[v]), len(repos[v]), copied) for s in by[i])
    assert any(len(held[v]) >= 5 for v in held) and any(len(held[v]) < 5 for v in held)
    assert secret_scan.scan_report(table(spark, [])).count() == 0


def test_redaction_bears_any_column_names(spark):
    text = "a password = correcthorsebattery " + "word " * 4000
    docs = table(spark, [doc(1, text), doc(None, text), doc(1, text), doc(2, None)]).withColumns({c: F.lit(c) for c in ("__id", "__th", "__spans", "th", "spans")})
    got = secret_scan.redact(docs).collect()
    assert len(got) == 4 and sum("[SECRET]" in (r["text"] or "") for r in got) == 3 and all(r["__id"] == "__id" and r["spans"] == "spans" for r in got)
    assert secret_scan.redact(docs).columns == docs.columns


# Shards


def test_equal_texts_share_a_shard_unless_they_are_many(spark):
    rng = random.Random(9)
    rows = [doc(i, " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randint(5, 60))), f"s{i % 5}", rng.choice(["en", "de"])) for i in range(3000)]
    rows += [doc(5000 + i, rows[i % 40][1], f"s{i % 3}", "fr") for i in range(80)]  # small groups
    rows += [doc(9000 + i, "hot text of a third", "hot") for i in range(1500)] + [doc(None, "no id")]
    df = table(spark, rows).withColumns({"node": F.lit("clash"), "size": F.lit(-5)})
    got = sharding.shard(df, shards=8).collect()
    again = sharding.shard(df.repartition(5), shards=8).collect()
    assert {r["doc_id"]: r["shard"] for r in got} == {r["doc_id"]: r["shard"] for r in again}
    by_text, sizes = defaultdict(set), Counter()
    text = {r[0]: r[1] for r in rows}
    for r in got:
        by_text[text[r["doc_id"]]].add(r["shard"])
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) < 1.03 * min(sizes.values()) and len(sizes) == 8
    assert all(len(s) == 1 for t, s in by_text.items() if t != "hot text of a third")
    for k in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))


def test_infinite_and_missing_dimensions(spark):
    rows = spark.createDataFrame([(i, f"text {i}", float(x)) for i, x in enumerate(["inf", "-inf", "nan", 1, 2, 3])], "doc_id bigint, text string, n_chars double")
    assert sharding.shard(rows, shards=2).count() == 6 and sharding.shard(rows.limit(0), shards=2).count() == 0


# Chat


def test_a_conversation_is_parsed_as_one_text(spark):
    rng = random.Random(3)
    parts = [*chat.CONTROLS, "\\", "<", "[", "/", "s>", "INST]", "x", " ", "\n", "NAME"]
    turns = [(rng.choice([*chat.MARKS, "tool", "", "[NAME]"]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))) for _ in range(400)]
    whole = "".join(chat.render(r, t) for r, t in turns)
    assert [x[:2] for x in chat.parse(whole)] == turns
    reader = chat._Reader(1)
    for at in range(0, len(whole), 7):  # cut anywhere
        reader.feed(whole[at : at + 7])
    assert reader.row()[1] == 400 and reader.row()[2] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    with pytest.raises(chat.ParseError):
        reader.feed("[INST] not closed")
        reader.row()
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string, segment string")
    assert chat.read_back(chat.formatted_turns(empty)).count() == 0


# Licences and languages


def test_license_cases(spark):
    long = "word " * 30000 + "Released under the MIT License. " + "word " * 30000
    rows = table(spark, [doc(1, long), doc(1, long), doc(2, None), doc(3, "")]).withColumn("findings", F.lit("clash"))
    assert sorted(r["licenses"] for r in license_scan.scan(rows).collect()) == ["", "", "MIT", "MIT"]
    assert license_scan.scan(table(spark, [])).count() == 0


def test_language_cases(spark):
    rows = table(spark, [doc(1, "some text here"), doc(1, "some text here"), doc(2, None), doc(3, "x " * 200000)])
    nothing = langid.identify(rows.withColumn("lang", F.lit(None).cast("string")))
    assert {(r["lang_pred"], r["score"]) for r in nothing.collect()} == {("und", 0.0)}
    got = langid.identify(rows.withColumns({"__guess": F.lit("mine"), "score": F.lit("old")}), steps=2)
    assert got.count() == 4 and {r["__guess"] for r in got.collect()} == {"mine"}
    assert langid.identify(table(spark, [])).count() == 0


# Pipeline


def test_the_pipeline_keeps_and_drops_what_it_should(spark, tmp_path):
    import corpus_pipeline

    bench = [("b1", " ".join(f"bench{i}" for i in range(30)))]
    plain = [f"{'the quick brown fox jumps over a lazy dog and runs' if i % 2 else 'der schnelle braune Fuchs springt und der faule Hund'} number{i} of the set {' '.join(f'v{i}n{j}' for j in range(20))}" for i in range(60)]
    rows = [doc(i, t, f"s{i % 4}", "en" if i % 2 else "de") for i, t in enumerate(plain)]
    rows += [doc(100, plain[3]), doc(101, plain[4] + " tail"), doc(102, f"before {bench[0][1]} after the text of some words"), doc(103, "12 34 --"), doc(104, None), doc(105, "my password = correcthorsebattery in some text of words")]
    rows += [doc(None, "a text without an id that is kept"), doc(None, "another text without an id"), doc(7, "the same id with a text of its own")]
    pd.DataFrame(bench, columns=["item_id", "text"]).to_parquet(f"{tmp_path}/benchmark.parquet")
    docs = table(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        docs = steps[name] = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
    ids = lambda n: Counter(r["doc_id"] for r in steps[n].select("doc_id").collect())
    assert all(sorted(steps[n].columns) == sorted(steps["language ID"].columns) for n in ("near-dedup", "decontamination", "secret scan"))
    after = ids("language ID")
    assert not after[103] and not after[104]
    near = ids("near-dedup")
    assert after - near == Counter({i: 1 for i in (100, 101) if after[i]})
    assert near - ids("decontamination") == Counter({102: near[102]}) and ids("decontamination") == ids("secret scan")
    assert "correcthorsebattery" not in "".join(r["text"] for r in steps["secret scan"].collect())
    packed = steps["packing"].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert {r["doc_id"] for r in packed} == set(ids("secret scan")) and all(r["n"] >= r["t"] for r in packed)


def test_a_word_is_remembered_in_one_form():
    """Capitals and marks behind a word add nothing to the memo; signs, special strings and other letters have the library's ids."""
    t = token_memo.tokenizer(WORDS)
    token_memo._memo.cache_clear()
    words = [f"gr{a}{b}nt" for a in "abcdefghij" for b in "klmnopqrst"]
    forms = " ".join(f"{w} {w.title()} {w}, {w}. {w.upper()}; {w}! {w}? {w}:" for w in words)
    odd = [
        "a, b", "a,b, c", "x's, y'S. z", 'say ("word"), "no". (yes). end.', "a.. b ... c., d", "_, a_, b", "1, 2. 3; \u00b2, \u00bd.", "a\t, b", " , a", "a ,", "A.\nB,\n\nC",
        "<|endoftext|>, a", "<|ENDOFTEXT|>, A.", "\u00c9t\u00e9, STRA\u00dfE. \u00b5; \u00aa, \u00ba.", "\u03a3\u0391\u03a3, \u03a3. a", "e\u0301t\u00e9, A\u030a.", "\u0130, I.", "a\u00a0, b", "a\x1c, b\x85. c", "",
    ]
    for text in [forms, *odd]:
        assert list(memoryview(token_memo.dropped_space_ids(WORDS, text)).cast("I")) == t.encode(text, add_special_tokens=False).ids, text
        if text is forms:
            assert len(token_memo._memo(WORDS, "", token_memo._packed, True)) <= len(words) + 10


def test_texts_are_counted_from_compressed_copies(spark, tmp_path):
    """What is shuffled of long texts is less than half of them, and counts are the library's."""
    t = token_memo.tokenizer(BYTES)
    texts = [*(" ".join(f"word{(i * j) % 97}" for j in range(900)) for i in range(20)), "", "\u00e9\u4f60 \U0001f600\x00 a", "a"]
    rows = [(i, x) for i, x in enumerate([*texts, *texts[:5], None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    packed = token_count.packed_texts(docs.filter("text IS NOT NULL").selectExpr("sha2(text, 256) AS digest", "text")).collect()
    assert len(packed) == len(rows) - 1 and sum(len(r["packed"]) for r in packed) * 2 < sum(len((x or "").encode()) for _, x in rows)
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_count.count_tokens(docs, str(tmp_path / "cache"), BYTES).collect()}
    assert got == {i: (len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows}
