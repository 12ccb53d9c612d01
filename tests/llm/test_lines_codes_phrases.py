"""Line dedup, vector codes and collocations against brute force, and their defined cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave.llm import collocations as C
from trackweave.llm import line_dedup as L
from trackweave.llm import vector_codes as V

LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def _key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def _kept_lines(texts, limit):
    held = Counter(k for t in texts for k in {_key(x) for x in (t or "").split("\n")} if k)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if held[_key(x)] < limit or not _key(x)]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def _line_texts():
    rng = random.Random(5)
    common = ["Menu | Home", "  menu | home\t", "Ärger Ü", "ärger ü", "(c) 2020", "a", "\x0bA\r"]
    texts = ["\n".join(rng.choice(common) if rng.random() < 0.4 else f"line {rng.randrange(40)}" for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    return [*texts, None, "", "\n", "\n\n x", texts[0], texts[0], "\n".join(["Menu | Home"] * 5000)]


@pytest.mark.parametrize("most", [100_000, 3])
def test_common_lines_go_from_every_document(spark, most):
    texts = _line_texts()
    ids = [None if i % 9 == 0 else i // 2 for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in zip(ids, texts, strict=True)], "doc_id int, text string, n long, h string, pos int")
    got = L.drop_common_lines(docs, limit=4, most_broadcast=most).collect()
    want = Counter((i, *w) for i, w in zip(ids, _kept_lines(texts, 4), strict=True))
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got) == want


def test_no_documents_no_lines(spark):
    assert L.drop_common_lines(spark.createDataFrame([], "doc_id int, text string")).count() == 0


def test_runs_are_compacted_and_found_again(spark):
    rng = random.Random(6)
    batches = [Counter(rng.randrange(200) for _ in range(300)) for _ in range(7)]
    runs = L.LineRuns(spark, limit=9, fan=3, buckets=4)
    total = Counter()
    for i, b in enumerate(batches):
        if i == 5:  # another session goes on in the same folder
            levels = sorted(runs.names)
            runs = L.LineRuns(spark, folder=runs.folder, limit=9, fan=3, buckets=4)
            assert sorted(runs.names) == levels and runs.batches == 5
        runs.add(spark.createDataFrame([(k, -k, n) for k, n in b.items()], "h long, g long, n long"))
        total.update(b)
    assert sorted(runs.names) == [(0, 6, 6), (1, 0, 2), (1, 3, 5)]
    got = {(r["h"], r["g"]): r["n"] for r in runs.common().collect()}
    assert set(got) == {(k, -k) for k, n in total.items() if n >= 9}
    assert all(9 <= n <= total[k[0]] for k, n in got.items())
    tables = [spark.table(f"{runs.names[r]}_open") for r in sorted(runs.names)[1:]]
    plan = L._added(*tables)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan  # equal buckets meet without a shuffle
    runs.drop()


def _codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [int(np.floor(1024 * x)) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = len(kept[0][1])
    fit = [r for r in kept if len(r[1]) == dim]
    w = dim // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in fit[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min((far(x, c), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for _, v, _ in fit:
                own[near(cut(v, p), books[p])[1]].append(cut(v, p))
            for e, xs in own.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out = []
    for i, v, lab in kept:
        got = [near(cut(v, p), books[p]) for p in range(parts)] if len(v) == dim else None
        out.append((i, lab, "".join(f"{e:02x}" for _, e in got) if got else None, sum(d for d, _ in got) if got else None))
    sums = defaultdict(lambda: None)
    for _, lab, _, e in out:
        sums[lab] = sums[lab] if e is None else (sums[lab] or 0) + e
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return Counter((i, code, e, sums[lab], digest) for i, lab, code, e in out)


def test_vector_codes_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(size=8) * 2).tolist(), int(rng.integers(3)) if i % 5 else None) for i in range(90)]
    rows += [(3, rows[3][1], 1), (3, [0.0] * 8, 1), (None, [0.25] * 8, 2), (500, None, 1), (501, [1.0, None] + [0.0] * 6, 1), (502, [float("nan")] * 8, 1), (503, [float("inf")] * 8, 0), (504, [-0.0001] * 8, 0), (505, [1.0] * 4, 7)]
    df = spark.createDataFrame([(*r, "x", 1.5, 9) for r in rows], "vec_id int, embedding array<double>, label int, code string, error double, vector int").repartition(5)
    for entries in (6, 256):
        got = Counter(map(tuple, V.compress(df, entries=entries).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()))
        assert got == _codes(rows, entries=entries)


def test_vector_codes_of_odd_tables(spark):
    kind = "vec_id int, embedding array<float>, label int"
    assert V.compress(spark.createDataFrame([], kind)).count() == 0
    assert V.compress(spark.createDataFrame([(1, None, 1)], kind)).count() == 0
    one = V.compress(spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0], None)], kind)).collect()
    assert [(r["code"], r["error"], r["label_error"]) for r in one] == [("00000000", 0, 0)]
    with pytest.raises(ValueError):
        V.compress(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1)], kind))


def _pieces(text):
    return [[w for w in re.split(r"[ \t]+", p) if w] for p in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER))]


def _collocations(rows, limit, percent, top, words=5):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for p in _pieces(text):
            n[lang or "und"] += len(p)
            for k in range(1, words + 1):
                f[lang or "und"].update(tuple(p[i : i + k]) for i in range(len(p) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {x: a for x, a in c.items() if len(x) > 1 and a >= limit}
        inner = set()
        for x, a in cand.items():
            for k in range(2, len(x)):
                inner |= {x[i : i + k] for i in range(len(x) - k + 1) if 100 * a >= percent * cand[x[i : i + k]]}
        rows_ = []
        for x, a in cand.items():
            score, k = min((1000 * a * n[lang] // (c[x[:k]] * c[x[k:]]), k) for k in range(1, len(x)))
            if x not in inner:
                rows_.append((-score, -a, " ".join(x).encode(), c[x[:k]], c[x[k:]]))
        for i, (s, a, x, left, r) in enumerate(sorted(rows_)[:top]):
            out.append((lang, i + 1, x.decode(), -a, left, r, n[lang], -s))
    return sorted(out)


def _phrase_rows():
    rng = random.Random(8)
    word = lambda: rng.choice(["the", "The", "of", "new", "York", "city", "œuvre", "über", "x", "y", "z"])
    text = lambda: "".join(word() + rng.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "; "]) for _ in range(rng.randrange(1, 40)))
    rows = [(text(), rng.choice(["en", "fr", None, "und"])) for _ in range(150)]
    return [*rows, (None, "en"), ("", None), ("...", "en"), ("new york city " * 30, "en"), ("  \t ", "fr"), rows[0], rows[0], ("only once here", "xx")]


@pytest.mark.parametrize("percent", [100, 60])
def test_collocations_equal_brute_force(spark, percent):
    rows = _phrase_rows()
    df = spark.createDataFrame([(*r, 1, "b") for r in rows], "text string, lang string, n int, phrase string").repartition(5)
    got = C.collocations(df, limit=6, percent=percent, top=25)
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == _collocations(rows, 6, percent, 25)


def test_sketches_may_be_small_and_texts_cut(spark, monkeypatch):
    """With more n-grams than cells nearly all survive; texts cut where pieces end count the same; tasks pass counts on early."""
    rows = _phrase_rows()
    raw = np.frombuffer(("ab, " * 40 + "c" * 50).encode(), np.uint8)
    monkeypatch.setattr(C, "CHUNK", 16)
    parts = list(C._cut(raw))
    assert len(parts) > 5 and b"".join(p.tobytes() for p in parts) == raw.tobytes()
    assert all(C._KIND[p[0]] == 2 for p in parts[1:])
    monkeypatch.undo()
    monkeypatch.setattr(C, "BLOCK", 64)
    df = spark.createDataFrame(rows, "text string, lang string")
    batches = [b for b in df.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).toArrow().to_batches()]
    monkeypatch.setattr(C, "HELD", 50)
    monkeypatch.setattr(C, "FLUSHED", 10)
    for width in (64, 4096):
        merged = C._merge(6)(C._sketch(width, 5)(iter(batches)))
        bits = np.zeros((C.ROWS, width // 8), np.uint8)
        for b in merged:
            at = b.column("block")[0].as_py() * 8
            bits[b.column("row")[0].as_py(), at : at + 8] = np.frombuffer(b.column("bits")[0].as_py(), np.uint8)
        total = Counter()
        for b in C._count(lambda bits=bits: bits, width, 5)(iter(batches)):
            for r in b.to_pylist():
                total[r["lang"], r["size"], r["phrase"]] += r["f"]
        want = Counter()
        for text, lang in rows:
            for p in _pieces(text):
                want[lang or "und", 0, ""] += len(p)
                for k in range(1, 6):
                    want.update((lang or "und", k, " ".join(p[i : i + k])) for i in range(len(p) - k + 1))
        assert all(total[k] == n for k, n in want.items() if n >= 6 or k[1] == 0)
        assert all(want[k] == n for k, n in total.items())  # what survives is counted exactly


def test_no_phrases(spark):
    assert C.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert C.collocations(spark.createDataFrame([(None, None)], "text string, lang string")).count() == 0
