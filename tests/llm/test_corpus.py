import hashlib
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trackweave.llm import chat, decontaminate, fingerprint, langid, license_scan, near_dup, packing, secret_scan, sharding, token_count, token_memo

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, th string"
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", "a  b", "a \nb", "a\n b", " a", "a ", "x<|endoftext|>y <|endoftext|>", "don't I'll  we've\t\ttab\r\n\r\nx", "\n\n\n", "Hello, World. ÉTÉ, été. ß! ÅNG. a.. b., c",
    "日本語 テキスト 1234 12a3b", "ΑΣ ΑΣ. İ é ́x", "a\x1cb \x1d d e", "word$$$ word&&& WORD!! ª º µ",
]
LONG = " ".join(f"word{i % 977} tail{i % 13}" for i in range(9000))


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words, 60)) for _ in range(30)]
    near = [" ".join("zz" if i == k else w for i, w in enumerate(base[0].split())) for k in range(12)]
    texts = [*TEXTS, *base, *near, base[1], base[1], base[2].upper(), LONG, None, None]
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}", len(t or ""), "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[20], (None, "no id at all here", None, None, None, None)], SCHEMA)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect() if r[key] is not None}


def test_memo_gives_the_library_ids():
    for text in [*TEXTS, LONG]:
        ids = Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids
        assert token_memo.dropped_space_ids(WORDS, text) == b"".join(struct.pack("<I", i) for i in ids)
        assert token_memo.byte_level_count(BYTES, text) == len(Tokenizer.from_file(BYTES).encode(text, add_special_tokens=False).ids)


def test_token_counts_and_a_warm_cache(spark, docs, tmp_path):
    cache, t = f"{tmp_path}/cache", Tokenizer.from_file(BYTES)
    for _ in range(2):
        got = token_count.count_tokens(docs, cache, BYTES)
        assert got.count() == docs.count()
        for i, r in by_id(got).items():
            text = next(x["text"] for x in docs.collect() if x["doc_id"] == i) or ""
            assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), len(t.encode(text, add_special_tokens=False).ids))
        assert spark.read.parquet(cache).count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert token_count.count_tokens(docs.limit(0), cache, BYTES).count() == 0


def test_packing_holds_each_id_once(docs):
    t = Tokenizer.from_file(WORDS)
    rows = packing.pack(docs, WORDS, window=64, bucket_pieces=40, keep_ids=True).collect()
    seen = Counter()
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        seen[r["sequence_id"]] += r["length"]
    assert max(seen.values()) <= 64
    for s in seen:
        own = sorted((r["offset"], r["length"]) for r in rows if r["sequence_id"] == s)
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and own[0][0] == 0
    for d in docs.collect():
        pieces = sorted({(r["start"], bytes(r["ids"])) for r in rows if r["doc_id"] == d["doc_id"]})
        want = b"".join(struct.pack("<I", i) for i in [*t.encode(d["text"] or "", add_special_tokens=False).ids, packing.END_ID])
        assert b"".join(p for _, p in pieces) == want
    assert packing.pack(docs.limit(0), WORDS).count() == 0


def test_best_fit_takes_the_tightest_window():
    fit, left = packing.BestFit(50), []
    for n in sorted(np.random.default_rng(3).integers(1, 51, 300).tolist(), reverse=True):
        fits = [c for c in left if c >= n]
        want = min(fits) if fits else 50
        at, offset = fit.put(n)
        assert 50 - offset == want
        if fits:
            left.remove(want)
        left.append(want - n)


def test_near_duplicates_equal_brute_force(docs):
    rows = [r for r in docs.collect() if r["doc_id"] is not None]
    sets = {}
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    got = near_dup.near_duplicates(docs)
    assert got.count() == docs.count()
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in by_id(got).items()} == {i: (len(s), comp[i], comp[i] == i) for i, s in sets.items()}
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_decontamination_equals_brute_force(spark, docs):
    rows = docs.collect()
    shared = " ".join(rows[20]["text"].split()[5:30])
    bench = spark.createDataFrame([(1, shared), (2, "W3 w4"), (3, None), (4, "!!"), (5, shared.upper() + " other words follow here"), (None, LONG[:200])], "item_id bigint, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = [(str(r["item_id"]) if r["item_id"] else None, words(r["text"])) for r in bench.collect()]
    got = by_id(decontaminate.decontamination_report(docs, bench))
    for r in rows:
        if r["doc_id"] is None:
            continue
        w, hit, found = words(r["text"]), set(), set()
        for item, own in items:
            n = min(10, len(own))
            for j in range(len(own) - n + 1 if own else 0):
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == own[j : j + n]:
                        hit |= set(range(i, i + n))
                        found |= {item} - {None}
        x = got[r["doc_id"]]
        assert (x["n_words"], x["n_hit"], x["n_items"], x["contaminated"]) == (len(w), len(hit), len(found), bool(hit))
        assert x["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    assert not any(r["contaminated"] for r in decontaminate.decontamination_report(docs, bench.limit(0)).collect())


def test_fingerprints_keep_the_rightmost_minimum(docs):
    rows = by_id(fingerprint.edit_report(docs))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect() if r["doc_id"] is not None}
    for i, r in rows.items():
        assert r["n_chars"] == len(texts[i]) and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    same = [i for i, t in texts.items() if t == texts[15]]
    assert len({rows[i]["fingerprint"] for i in same}) == 1
    order = sorted(texts)
    for a, b in zip(order[:-2], order[1:-1], strict=True):
        q = len(texts[a]) // 4
        edited = texts[a][: len(texts[a]) - q] + texts[b][:q]
        if [r["doc_id"] for r in docs.collect()].count(b) == 1 and [r["doc_id"] for r in docs.collect()].count(a) == 1:
            assert rows[a]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert fingerprint.edit_report(docs.limit(0)).count() == 0


def test_shards_have_equal_bytes_and_gapless_slots(spark):
    rows = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'one copy' WHEN id % 50 = 1 THEN NULL ELSE repeat('é', int(id % 90)) END AS text", "IF(id % 2 = 0, 'x', 'y') AS source", "id % 90 AS n_chars")
    got = sharding.shard(rows, shards=7).toPandas()
    assert len(got) == 4000 and set(got["shard"]) == set(range(7)) and set(got["law"]) == {"bytes"}
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    sums = got.groupby("shard")["size"].sum()
    assert sums.max() / sums.min() < 1.05
    text = {r["doc_id"]: (r["text"] or "").encode() for r in rows.collect()}
    for i, size, crc in zip(got["doc_id"], got["size"], got["text_crc32"], strict=True):
        assert (size, crc) == (len(text[i]) + 16, zlib.crc32(text[i]))
    assert sharding.shard(rows.limit(0)).count() == 0


def test_chat_reads_back_what_was_said(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "system", "be <<SYS>> kind"), (1, 1, "user", said), (1, 2, "assistant", "[\\INST]" + said), (2, 0, None, None), (2, 1, "to[NAME]ol\n", "x\\"), (2, 1, "assistant", "y"), (2, 1, "assistant", "y"), (None, 0, "user", "z")]
    conv = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = by_id(chat.read_back(chat.formatted_turns(conv)), "conv_id")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for _, _, r, t in rows[:3])) and got[1]["loss_sha256"] == sha(rows[2][3])
    assert got[2]["n_turns"] == 4 and got[2]["loss_chars"] == 2
    for role, text in [(r or "", t or "") for _, _, r, t in rows]:
        out = chat.render(role, text)
        assert [x[:2] for x in chat.parse(out)] == [(role, text)] and chat.unescaped(chat.escaped(text)) == text


def test_secrets_equal_the_patterns(spark):
    key = "AKIA" + "Q7" * 9
    texts = ["token=secret=short token: abcdefghijkl", "PASSWORD = 'hunter2hunter2' deadbeefdeadbeefdead", f"x{key}y {key[:10]}", "token=token:abcdefghijklmnop", "né api_key: \"ABCdef123456_-\" é", None, "", "Ab1" * 9]
    df = spark.createDataFrame([(i, t, f"s{i}", "x") for i, t in enumerate(texts)], "doc_id bigint, text string, source string, spans string")
    kinds = [re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")]
    got = by_id(secret_scan.scan_report(df))
    for i, t in enumerate(texts):
        spans = sorted((m.start(), k, m.end()) for k, p in enumerate(kinds) for m in p.finditer(t or "") if len(m[2] if k == 0 else m[0]) >= (12, 18, 16)[k])
        said = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert got[i]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert got[7]["spans"] == "token:0:27"
    clean = by_id(secret_scan.redact(df))
    assert clean[1]["text"] == "[SECRET]' [SECRET]" and clean[5]["text"] is None and clean[6]["text"] == ""
    many = spark.createDataFrame([(i, "token = exampleexample", f"s{i}") for i in range(9)], "doc_id bigint, text string, source string")
    assert {r["n_live"] for r in secret_scan.scan_report(many).collect()} == {0}


def test_licenses_are_told_apart(spark):
    texts = ["a\nReleased under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "This work is licensed under the GNU General Public License, version 2.", "a licence for fishing", None, "none"]
    got = by_id(license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")))
    assert [got[i]["licenses"] for i in range(7)] == ["MIT", "Apache-2.0", "GPL-3.0", "GPL-2.0", "", "", ""]
    assert [got[i]["n_blocks"] for i in range(7)] == [1, 1, 1, 1, 1, 0, 0]


def test_whole_notices_are_found(spark):
    from textwrap import wrap

    T = license_scan.TEMPLATES
    comment = lambda w, mark: "int x;\n" + "\n".join(f"{mark} {x}" for x in wrap(w, 40)) + "\nend"
    noise = " ".join(f"word{i}" for i in range(400))
    texts = {
        **{f"{name}:{i}:{mark}": (comment(w, mark), name) for name, ws in T.items() for i, w in enumerate(ws) for mark in ("#", " *", "//", "")},
        **{f"{name}:{i}:long": (f"{noise} {w} {noise}", name) for name, ws in T.items() for i, w in enumerate(ws)},
        "dual": ("Licensed under the Apache License, Version 2.0 or the MIT License, at your option.", "Apache-2.0,MIT"),
        "dual2": ("Licensed under either of the MIT License or the Apache License, Version 2.0.", "Apache-2.0,MIT"),
        "lines": ("Released under the MIT License.\nLicensed under CC BY-NC 4.0.", "CC-BY-NC-4.0,MIT"),
        "lesser": ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
        "none": (f"{noise} licence {noise}\ncopyright the licence and redistribution of the permission", ""),
    }
    keys = list(texts)
    got = by_id(license_scan.scan(spark.createDataFrame([(i, texts[k][0]) for i, k in enumerate(keys)], "doc_id bigint, text string")))
    assert {k: got[i]["licenses"] for i, k in enumerate(keys)} == {k: v for k, (_, v) in texts.items()}
    assert got[keys.index("MIT:2:#")]["findings"][0]["line"] == 1 and got[keys.index("MIT:2:#")]["n_blocks"] >= 1


def test_gradients_of_the_network():
    net, rng = langid.Network.fresh(["a", "b"], 3, 1), np.random.default_rng(0)
    x, y, real = rng.integers(1, 255, (5, 4)).astype(np.uint8), np.array([0, 1, 1, 0]), np.ones((5, 4), np.float32)
    for w, g in net.learn(x, y, real)[1]:
        for k in g:
            at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
            old, ends = w[k][at], []
            for step in (1e-2, -1e-2):
                w[k][at] = old + step
                ends.append(net.learn(x, y, real)[0])
            w[k][at] = old
            assert abs((ends[0] - ends[1]) / 2e-2 - g[k][at]) < 1e-3


def test_languages_are_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").unionByName(spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "12 34 ...", "en", "s", 9)], "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    got = langid.identify(docs, steps=250).toPandas()
    held = got[got["held_out"] & got["text"].notna() & (got["doc_id"] >= 0)]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.97
    assert set(got.loc[got["doc_id"] < 0, "lang_pred"]) == {"und"} and got["score"].between(0, 1).all()


def test_pipeline_stages_keep_columns(spark, docs, tmp_path):
    import corpus_pipeline as P

    docs = docs.drop("th")
    spark.createDataFrame([(1, docs.collect()[20]["text"])], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in P.STAGES[1:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
    left = {r["doc_id"] for r in docs.collect()}
    assert 20 not in left and 14 in left and not left & {44, 45, 56, 57, 58}


def test_pipeline_keeps_rows_of_null_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline as P

    text = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdef"]
    near = text[0].replace("a20 ", "zz ")
    rows = [(None, text[0]), (None, text[0]), (None, text[1]), (7, text[2]), (7, text[2]), (7, text[3]), (-1, text[0]), (9, near), (9, text[4]), (None, None), (8, text[5])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = lambda df: sorted(map(tuple, df.collect()), key=repr)
    want = sorted([(None, text[0]), (None, text[0]), (None, text[1]), (None, None), (7, text[2]), (7, text[3]), (-1, text[0]), (9, text[4]), (8, text[5])], key=repr)
    assert left(P.near_dedup(spark, docs, "")) == want
    assert left(P.near_dedup(spark, docs.withColumn("doc_id", F.col("doc_id").cast("string")), "")) == sorted([(None if i is None else str(i), t) for i, t in want], key=repr)
    once = docs.filter("doc_id IS NULL OR doc_id IN (-1, 8)")
    assert left(P.near_dedup(spark, once, "")) == left(once)
    spark.createDataFrame([(1, text[1]), (2, text[2])], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert left(P.decontamination(spark, docs, str(tmp_path))) == sorted([r for r in rows if r[1] not in text[1:3]], key=repr)
