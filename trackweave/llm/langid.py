"""Language identification by a bidirectional gated recurrent network over bytes (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackweave.llm.scratch import lean, small_batches
from trackweave.session import reach_workers

#: Bytes of a window: the states start anew in each. A text's windows cover all of it.
SPAN = 64
HIDDEN = 8
#: The bounded sample that the network is fitted on: texts of each language, and characters of each text.
SAMPLE_TEXTS, SAMPLE_CHARS = 400, 512
STEPS, BATCH, RATE, SEED = 500, 256, 0.02, 7
#: Windows that a task runs at a time.
BLOCK = 2048
#: Texts whose bytes are held as windows at a time.
TEXTS = 500
UNKNOWN = "und"


def _sigmoid(x: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    out = np.multiply(x, 0.5, out=out)
    np.tanh(out, out=out)
    out *= 0.5
    out += 0.5
    return out


@dataclass
class Network:
    """Weights: for each direction ``e`` (3H x 256, input by byte), ``u`` (3H x H), ``c`` (H), ``o`` (L x H); and ``b`` (L)."""

    langs: list[str]
    forward: dict[str, np.ndarray]
    backward: dict[str, np.ndarray]
    bias: np.ndarray

    @classmethod
    def fresh(cls, langs: list[str], hidden: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        one = lambda: {
            "e": rng.normal(0, 0.3, (3 * hidden, 256)).astype(np.float32), "u": rng.normal(0, hidden**-0.5, (3 * hidden, hidden)).astype(np.float32),
            "c": np.zeros((hidden, 1), np.float32), "o": rng.normal(0, 0.3, (len(langs), hidden)).astype(np.float32),
        }
        return cls(langs, one(), one(), np.zeros((len(langs), 1), np.float32))

    @staticmethod
    def _run(w: dict, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states (T x H x B) for bytes ``x`` (T x B), in the order of ``x``."""
        h = w["u"].shape[1]
        out = np.empty((len(x), h, x.shape[1]), np.float32)
        state = np.zeros((h, x.shape[1]), np.float32)
        for t in range(len(x)):
            g = np.take(w["e"], x[t], axis=1)
            a = w["u"] @ state
            gates = _sigmoid(g[: 2 * h] + a[: 2 * h])
            z, r = gates[:h], gates[h:]
            c = a[2 * h :] + w["c"]
            n = np.tanh(g[2 * h :] + r * c)
            new = n + z * (state - n)
            if keep is not None:
                keep.append((z, r, c, n, state))
            out[t] = state = new
        return out

    def label(self, x: np.ndarray) -> np.ndarray:
        """Probability of each language at each position: T x L x B."""
        logits = self.forward["o"] @ self._run(self.forward, x)
        logits += (self.backward["o"] @ self._run(self.backward, x[::-1]))[::-1]
        logits += self.bias
        np.exp(logits, out=logits)  # the states are within -1 and 1, so logits stay small
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def learn(self, x: np.ndarray, y: np.ndarray, real: np.ndarray) -> tuple[float, list[tuple[dict, dict]], np.ndarray]:
        """Loss and gradients for windows ``x`` (T x B) of languages ``y`` (B); ``real`` marks bytes that are no padding."""
        tapes: list[list] = [[], []]
        sides = [(self.forward, x, 1), (self.backward, x[::-1], -1)]
        states = [self._run(w, b, tape) for (w, b, _), tape in zip(sides, tapes, strict=True)]
        logits = self.bias + sum((w["o"] @ s)[::step] for (w, _, step), s in zip(sides, states, strict=True))
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        pick = np.zeros_like(p)
        pick[:, y, np.arange(len(y))] = 1
        weight = real[:, None, :] / real.sum()
        loss = float(-(weight * pick * np.log(p + 1e-9)).sum())
        d = ((p - pick) * weight).astype(np.float32)
        grads = []
        for (w, b, step), s, tape in zip(sides, states, tapes, strict=True):
            h, own = s.shape[1], d[::step]
            g = {"o": np.einsum("tlb,thb->lh", own, s), "u": np.zeros_like(w["u"]), "c": np.zeros_like(w["c"])}
            inputs = np.empty((len(b), 3 * h, b.shape[1]), np.float32)
            carry = np.zeros_like(s[0])
            for t in range(len(b) - 1, -1, -1):
                z, r, c, n, before = tape[t]
                dh = w["o"].T @ own[t] + carry
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (before - n) * z * (1 - z)
                dr = dn * c * r * (1 - r)
                inputs[t] = np.concatenate((dz, dr, dn))
                da = np.concatenate((dz, dr, dn * r))
                g["u"] += da @ before.T
                g["c"] += (dn * r).sum(axis=1, keepdims=True)
                carry = dh * z + w["u"].T @ da
            flat = b.ravel()
            g["e"] = np.stack([np.bincount(flat, weights=inputs[:, i].ravel(), minlength=256) for i in range(3 * h)]).astype(np.float32)
            grads.append((w, g))
        return loss, grads, d.sum(axis=(0, 2))[:, None]


def windows_of(raw: list[bytes], span: int) -> tuple[np.ndarray, np.ndarray]:
    """Consecutive windows that cover the texts (N x span, zero behind the end), and the text of each."""
    counts = np.array([-(-len(r) // span) for r in raw], np.int64)
    joined = b"".join(r + bytes(-len(r) % span) for r in raw)
    return np.frombuffer(joined, np.uint8).reshape(-1, span), np.repeat(np.arange(len(raw)), counts)


def fit(texts: list[str], labels: list[str], *, hidden: int = HIDDEN, span: int = SPAN, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> Network:
    """Fit by backpropagation through time (Adam), languages weighted alike by drawing."""
    langs = sorted(set(labels))
    net = Network.fresh(langs, hidden, seed)
    raw = [t.encode() for t in texts]
    x, owner = windows_of(raw, span)
    y = np.array([langs.index(v) for v in labels])[owner]
    rng = np.random.default_rng(seed)
    groups = [np.flatnonzero(y == i) for i in range(len(langs))]
    moments: dict[tuple[int, str], list[np.ndarray]] = {}
    for step in range(1, steps + 1):
        at = np.concatenate([rng.choice(g, max(1, batch // len(langs))) for g in groups if len(g)])
        b = np.ascontiguousarray(x[at].T)
        _, grads, bias = net.learn(b, y[at], (b != 0).astype(np.float32))
        now = rate * (1 - step / (steps + 1))
        for i, (w, g) in enumerate([*grads, ({"b": net.bias}, {"b": bias})]):
            for k, grad in g.items():
                m, v = moments.setdefault((i, k), [np.zeros_like(grad), np.zeros_like(grad)])
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                w[k] -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return net


def held_out(id_col: str) -> Column:
    """Rows that are never learned from: CRC-32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """At most ``texts`` rows of each language, picked by a hash of the id; of each, ``chars`` characters from anywhere."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col).cast("string"), F.lit(SEED)).alias("h"), F.col(text_col).alias("text"))
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, 2 * texts / n + 100 / n))])
    place = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - chars, F.lit(0)) + 1).cast("int")
    drawn = known.filter(F.pmod(F.col("h"), F.lit(1 << 30)) / float(1 << 30) < F.try_element_at(share, F.col("lang")))
    drawn = drawn.select("lang", "h", F.substring("text", place + 1, F.lit(chars)).alias("text")).filter(has_letter(F.col("text")))
    order = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    return [(r["text"], r["lang"]) for r in drawn.withColumn("k", order).filter(F.col("k") <= texts).orderBy("lang", "h", "text").collect()]


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> Network | None:
    """A network fitted on a bounded sample of labelled rows; None if no row has a language."""
    drawn = sample(docs, id_col, text_col, lang_col)
    return fit([t for t, _ in drawn], [lang for _, lang in drawn], **options) if drawn else None


def pooled(net: Network, raw: list[bytes], span: int = SPAN, block: int = BLOCK) -> np.ndarray:
    """Mean of the positions' probabilities of each text (N x L); zeros for empty ones."""
    x, owner = windows_of(raw, span)
    total, size = np.zeros((len(raw), len(net.langs))), np.array([len(r) for r in raw])
    for at in range(0, len(x), block):
        b = np.ascontiguousarray(x[at : at + block].T)
        p = net.label(b)
        first = np.searchsorted(owner, owner[at : at + block])
        own = np.clip(size[owner[at : at + block]] - (np.arange(at, at + b.shape[1]) - first) * span, 0, span)
        p *= (np.arange(span)[:, None] < own)[:, None, :]
        np.add.at(total, owner[at : at + block], p.sum(axis=0).T)
    return total / np.maximum(1, [[len(r)] for r in raw])


def predict(docs: DataFrame, net: Network | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (the pooled probability of that language) to all rows, other columns kept.

    Defined cases: a text that is null or has no letter is ``und`` with score 0; so are all texts
    if there was nothing to learn from; repeated rows each get a row; an empty table gives none.
    Columns of the names ``lang_pred`` and ``score`` are replaced.
    """
    reach_workers(docs.sparkSession)
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")

    def label(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"lang": [UNKNOWN] * len(texts), "score": np.zeros(len(texts))})
        some = np.flatnonzero(texts.notna().to_numpy())
        if net and len(some):
            p = np.concatenate([pooled(net, [texts.iloc[i].encode() for i in some[at : at + TEXTS]]) for at in range(0, len(some), TEXTS)])
            out.loc[some, "lang"] = [net.langs[i] for i in p.argmax(axis=1)]
            out.loc[some, "score"] = np.minimum(1.0, p.max(axis=1))
        return out

    @F.pandas_udf("lang string, score double")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from lean(lambda xs: map(label, xs))(batches)

    letter = has_letter(F.col(text_col))
    name = "__guess"
    while name in docs.columns:
        name += "_"
    got = docs.withColumn(name, guess(F.when(letter, F.col(text_col))))
    return got.withColumns({"lang_pred": F.col(f"{name}.lang"), "score": F.col(f"{name}.score")}).drop(name)


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """Train on the labelled rows that aren't held out, predict all: adds ``lang_pred``, ``score`` and ``held_out``."""
    net = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **options)
    return predict(docs, net, id_col=id_col, text_col=text_col).withColumn("held_out", held_out(id_col))
