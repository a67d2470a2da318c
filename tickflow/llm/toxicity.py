"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as a hashed word embedding beside the mean of its hashed character
trigram embeddings.  Two gated recurrent layers read a window of words, one in
each direction; attention weighs their states into one vector and a logistic
unit scores it.  A document's score is that of its highest window, over all
overlapping windows of its whole text.  Training (numpy, on the driver) takes a
bounded sample of labelled rows and passes the gradient through the highest
window of each document; a shift of the bias undoes the balance of the sample.

What a word adds to the gates is computed once per distinct word of a batch.

Defined results for odd input
-----------------------------
* null, empty or blank text: one window without words, scored by the bias alone;
* repeated rows and ids are scored each; ties have no part in it;
* an empty table gives no rows; without labelled rows of both classes all
  documents get the share of class 1 as their score;
* labels that are null, or of documents that are not there, are not used.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickflow.llm.shared import chunks, released

WORDS = regex.compile(r"[^\x20\x09-\x0D]+").findall


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the labelled rows of each class, ``sample_bytes`` their texts."""

    sample: int = 1000
    sample_bytes: int = 32_768
    words: int = 1 << 15
    grams: int = 1 << 13
    word_dim: int = 8
    gram_dim: int = 12
    hidden: int = 8
    attention: int = 8
    window: int = 64
    stride: int = 48
    steps: int = 480
    batch: int = 32
    rate: float = 0.02
    seed: int = 7


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Lexicon:
    """Rows of distinct words: hashed word, and hashed trigrams with their owners."""

    settings: Settings
    rows: dict[str, int] = field(default_factory=dict)

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word hashes, trigram hashes, and where each word's trigrams start."""
        s = self.settings
        raw = [w.encode("utf-8", "replace") for w in words]
        word = np.array([zlib.crc32(b) for b in raw], np.uint32) % np.uint32(s.words)
        sizes = np.array([len(b) + 2 for b in raw])
        data = np.frombuffer(b"^" + b"$^".join(raw) + b"$", np.uint8).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        code = (data[:-2] * np.uint32(65536) + data[1:-1] * np.uint32(256) + data[2:]) * np.uint32(2654435761)
        gram = (code >> np.uint32(16)) % np.uint32(s.grams)
        owner = np.repeat(np.arange(len(raw)), sizes)[: len(gram)]
        inside = np.arange(len(gram)) < (starts + sizes - 2)[owner]
        gram, owner = gram[inside], owner[inside]
        first = np.searchsorted(owner, np.arange(len(raw)))
        return word.astype(np.int64), gram.astype(np.int64), first


def split_words(text: str | None) -> list[str]:
    return [w.lower() for w in WORDS(text or "")]


def windows(ids: np.ndarray, size: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping windows that cover all of ``ids``, and the length of each."""
    n = max(1, -(-max(0, len(ids) - size) // stride) + 1)
    at = np.arange(n)[:, None] * stride + np.arange(size)[None]
    lengths = np.clip(len(ids) - np.arange(n) * stride, 0, size)
    padded = np.concatenate([ids, np.zeros(1, ids.dtype)]) if len(ids) else np.zeros(1, np.int64)
    return padded[np.minimum(at, len(padded) - 1)], lengths


class Network:
    """Parameters and passes; arrays are (time, window, unit)."""

    def __init__(self, s: Settings):
        self.s, rng = s, np.random.default_rng(s.seed)
        d, h, a = s.word_dim + s.gram_dim, s.hidden, s.attention
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "word": draw(s.words, s.word_dim, scale=0.1),
            "gram": draw(s.grams, s.gram_dim, scale=0.3),
            "Va": draw(2 * h, a, scale=0.3),
            "ba": np.zeros(a, np.float32),
            "va": draw(a, scale=0.3),
            "wo": draw(2 * h, scale=0.3),
            "bo": np.full(1, -1, np.float32),
        }
        for k in "fb":
            self.p |= {f"W{k}": draw(d, 3 * h, scale=0.4), f"U{k}": draw(h, 3 * h, scale=0.3), f"b{k}": np.zeros(3 * h, np.float32)}

    def inputs(self, word: np.ndarray, gram: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = np.diff(np.append(first, len(gram)))
        sums = np.add.reduceat(self.p["gram"][gram], first, axis=0) if len(gram) else np.zeros((len(word), self.s.gram_dim))
        return np.concatenate([self.p["word"][word], sums / np.maximum(counts, 1)[:, None]], 1).astype(np.float32), counts

    def _read(self, gates: np.ndarray, mask: np.ndarray, key: str, keep: bool):
        """States of one direction; ``gates`` (T, N, 3H) is what the inputs add."""
        h_dim, u = self.s.hidden, self.p[f"U{key}"]
        steps, n = gates.shape[:2]
        h = np.zeros((n, h_dim), np.float32)
        out, kept = np.empty((steps, n, h_dim), np.float32), []
        for t in range(steps) if key == "f" else range(steps - 1, -1, -1):
            hu = h @ u
            zr = _sigmoid(gates[t, :, : 2 * h_dim] + hu[:, : 2 * h_dim])
            z, r = zr[:, :h_dim], zr[:, h_dim:]
            c = np.tanh(gates[t, :, 2 * h_dim :] + r * hu[:, 2 * h_dim :])
            if keep:
                kept.append((t, h, z, r, c, hu[:, 2 * h_dim :]))
            h = h + mask[t][:, None] * (1 - z) * (c - h)
            out[t] = h
        return out, kept

    def forward(self, x: np.ndarray, ids: np.ndarray, lengths: np.ndarray, keep: bool = False):
        """Logits of windows ``ids`` (N, T) over the word rows ``x``."""
        p, steps = self.p, ids.shape[1]
        at = np.ascontiguousarray(ids.T)
        mask = (np.arange(steps)[:, None] < lengths[None]).astype(np.float32)
        outs, kept = [], {}
        for k in "fb":
            out, kept[k] = self._read((x @ p[f"W{k}"] + p[f"b{k}"])[at], mask, k, keep)
            outs.append(out)
        h = np.concatenate(outs, 2)
        u = np.tanh(h @ p["Va"] + p["ba"])
        e = np.where(mask > 0, u @ p["va"], np.float32(-1e30))
        e = np.exp(e - e.max(0)) * mask
        alpha = e / np.maximum(e.sum(0), np.float32(1e-30))
        pooled = np.einsum("tn,tnh->nh", alpha, h)
        logit = pooled @ p["wo"] + p["bo"][0]
        return (logit, (at, mask, kept, h, u, alpha, pooled)) if keep else logit

    def backward(self, x: np.ndarray, state, d_logit: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of all but the embeddings, and of ``x``."""
        p, hd = self.p, self.s.hidden
        at, mask, kept, h, u, alpha, pooled = state
        g = {"wo": pooled.T @ d_logit, "bo": np.array([d_logit.sum()], np.float32)}
        d_pooled = d_logit[:, None] * p["wo"]
        d_alpha = np.einsum("nh,tnh->tn", d_pooled, h)
        d_e = alpha * (d_alpha - (alpha * d_alpha).sum(0))
        g["va"] = np.einsum("tn,tna->a", d_e, u)
        d_u = d_e[..., None] * p["va"] * (1 - u * u)
        g["Va"], g["ba"] = np.einsum("tnh,tna->ha", h, d_u), d_u.sum((0, 1))
        d_h = alpha[..., None] * d_pooled[None] + d_u @ p["Va"].T
        d_x = np.zeros_like(x)
        for side, k in enumerate("fb"):
            w, uu = p[f"W{k}"], p[f"U{k}"]
            g[f"U{k}"] = np.zeros_like(uu)
            d_gates = np.zeros((*at.shape, 3 * hd), np.float32)
            carry = np.zeros((at.shape[1], hd), np.float32)
            for t, before, z, r, c, hc in reversed(kept[k]):
                dh = carry + d_h[t, :, side * hd : (side + 1) * hd]
                m = mask[t][:, None]
                dc = dh * m * (1 - z) * (1 - c * c)
                dz = dh * m * (before - c) * z * (1 - z)
                dr = dc * hc * r * (1 - r)
                d_hu = np.concatenate([dz, dr, dc * r], 1)
                g[f"U{k}"] += before.T @ d_hu
                d_gates[t] = np.concatenate([dz, dr, dc], 1)
                carry = dh * (1 - m * (1 - z)) + d_hu @ uu.T
            flat = d_gates.reshape(-1, 3 * hd)
            per_word = np.zeros((len(x), 3 * hd), np.float32)
            np.add.at(per_word, at.reshape(-1), flat)
            g[f"W{k}"], g[f"b{k}"] = x.T @ per_word, flat.sum(0)
            d_x += per_word @ w.T
        return g, d_x


def train(texts: list[str], labels: list[int], s: Settings = Settings()) -> Network:
    """Adam on the logistic loss of each document's highest window.

    Empty texts are added as clean examples, one for each 40 rows, so that the bias alone is clean.
    """
    blank = len(texts) // 40 + 1
    texts, labels = [*texts, *[""] * blank], [*labels, *[0] * blank]
    net, rng = Network(s), np.random.default_rng(s.seed)
    lexicon = Lexicon(s)
    docs = []
    for text in texts:
        words = split_words(text)
        for w in words:
            lexicon.rows.setdefault(w, len(lexicon.rows))
        docs.append(windows(np.array([lexicon.rows[w] for w in words], np.int64), s.window, s.stride))
    vocabulary = list(lexicon.rows) or [""]
    word, gram, first = lexicon.codes(vocabulary)
    owner = np.repeat(np.arange(len(word)), np.diff(np.append(first, len(gram))))
    y = np.array(labels, np.float32)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    epochs = -(-s.steps // -(-len(docs) // s.batch))
    step, total = 0, epochs * -(-len(docs) // s.batch)
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), s.batch):
            pick = order[at : at + s.batch]
            ids = np.concatenate([docs[i][0] for i in pick])
            lengths = np.concatenate([docs[i][1] for i in pick])
            rows, local = np.unique(ids, return_inverse=True)
            local = local.reshape(ids.shape)
            grams = np.concatenate([np.arange(first[r], first[r + 1] if r + 1 < len(first) else len(gram)) for r in rows])
            counts = np.diff(np.append(first, len(gram)))[rows]
            starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
            x, _ = net.inputs(word[rows], gram[grams], starts)
            logits = net.forward(x, local, lengths)
            ends = np.cumsum([len(docs[i][0]) for i in pick])
            best = np.array([b - n + int(np.argmax(logits[b - n : b])) for b, n in zip(ends, (len(docs[i][0]) for i in pick), strict=True)])
            logit, state = net.forward(x, local[best], lengths[best], keep=True)
            g, d_x = net.backward(x, state, ((_sigmoid(logit) - y[pick]) / len(pick)).astype(np.float32))
            g["word"] = np.zeros_like(net.p["word"])
            np.add.at(g["word"], word[rows], d_x[:, : s.word_dim])
            g["gram"] = np.zeros_like(net.p["gram"])
            per_gram = (d_x[:, s.word_dim :] / counts[:, None])[np.repeat(np.arange(len(rows)), counts)]
            np.add.at(g["gram"], gram[grams], per_gram)
            step += 1
            rate = s.rate * min(1.0, step / 20) * (1 - 0.9 * step / total)
            for k, v in net.p.items():
                m1, m2 = moments[k]
                m1 += 0.1 * (g[k] - m1)
                # One scale for a whole table of embeddings: scaled alone, rare words would be learned by heart.
                square = g[k] ** 2 if k not in ("word", "gram") else (g[k] ** 2).sum() / max(1, np.count_nonzero(g[k]))
                m2 += 0.005 * (square - m2)
                v -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.995**step)) + 1e-7)
    del owner
    return net


class Scorer:
    """Scores texts in bounded memory; carries the rows of words it has met."""

    def __init__(self, net: Network, shift: float, most_words: int = 120_000):
        self.net, self.shift, self.most = net, shift, most_words
        self.lexicon, self.x = Lexicon(net.s), np.zeros((0, net.s.word_dim + net.s.gram_dim), np.float32)

    def _ids(self, words: list[str]) -> np.ndarray:
        rows = self.lexicon.rows
        new = [w for w in dict.fromkeys(words) if w not in rows]
        if new:
            for k, w in enumerate(new, len(rows)):
                rows[w] = k
            x, _ = self.net.inputs(*self.lexicon.codes(new))
            self.x = np.concatenate([self.x, x])
        return np.fromiter(map(rows.__getitem__, words), np.int64, len(words))

    def score(self, texts: list[str | None]) -> np.ndarray:
        s = self.net.s
        out = np.empty(len(texts))
        for lo in range(0, len(texts), 400):
            part = [split_words(t) for t in texts[lo : lo + 400]]
            if len(self.x) > self.most:
                self.lexicon, self.x = Lexicon(s), self.x[:0]
            ids = self._ids([w for words in part for w in words] or [""])
            cut, at = [], 0
            for words in part:
                cut.append(windows(ids[at : at + len(words)], s.window, s.stride))
                at += len(words)
            all_ids, lengths = np.concatenate([c[0] for c in cut]), np.concatenate([c[1] for c in cut])
            logits = np.concatenate([self._logits(all_ids[k : k + 1024], lengths[k : k + 1024]) for k in range(0, len(all_ids), 1024)])
            starts = np.concatenate([[0], np.cumsum([len(c[0]) for c in cut])[:-1]])
            out[lo : lo + len(part)] = np.maximum.reduceat(logits, starts)
        return 1 / (1 + np.exp(-(out + self.shift)))

    def _logits(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        rows, local = np.unique(ids, return_inverse=True)
        return self.net.forward(self.x[rows], local.reshape(ids.shape), lengths).astype(np.float64)


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> tuple[Network | None, float]:
    """The network, and the shift of its logits to the share of class 1 in all labelled rows.

    Trains on labelled rows whose crc32(doc_id) mod 4 is not 2: of each class the
    ``s.sample`` rows of lowest hash among texts of up to ``s.sample_bytes``.
    """
    known = labels.filter("toxic IS NOT NULL").select(F.col("doc_id"), (F.col("toxic") > 0).cast("int").alias("label"))
    known = known.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    if not counts.get(0) or not counts.get(1):
        share = counts.get(1, 0) / max(1, sum(counts.values()))
        return None, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    texts = docs.select("doc_id", "text").filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= s.sample_bytes)
    rows = []
    for label in (0, 1):
        order = F.md5(F.concat_ws(":", F.lit(str(s.seed)), F.col("doc_id").cast("string")))
        part = known.filter(F.col("label") == label).withColumn("order", order)
        # Twice the sample is picked by hash first; documents that are missing or too long leave gaps.
        part = part.orderBy("order", "doc_id").limit(2 * s.sample)
        picked = texts.join(F.broadcast(part), "doc_id").orderBy("order", "doc_id", "text").limit(s.sample)
        rows += [(r["text"] or "", label) for r in picked.select("text").collect()]
    n1 = sum(r[1] for r in rows)
    n0 = len(rows) - n1
    if not n1 or not n0:  # labels of documents that are not there
        return None, float(np.log(counts[1] / counts[0]))
    net = train([r[0] for r in rows], [r[1] for r in rows], s)
    return net, float(np.log(counts[1] / counts[0]) - np.log(n1 / n0))


def score_documents(docs: DataFrame, model: tuple[Network | None, float], carry: list[str], text: str = "text") -> DataFrame:
    """``carry`` columns of ``docs`` and ``score`` for every row; ``text`` names the column to score, and may be carried.

    A column ``score`` of ``docs`` gives way to the operator's.
    """
    net, shift = model
    carry = [c for c in carry if c != "score"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)
    if net is None:
        return docs.select(*carry, F.lit(float(1 / (1 + np.exp(-shift)))).alias("score"))
    sent = [*carry, *([] if text in carry else [text])]
    at = sent.index(text)

    @released
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net, shift)
        for batch in chunks(batches, text, 1 << 20):
            scores = pa.array(scorer.score(batch.column(at).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], scores], [*carry, "score"])

    return docs.select(*sent).mapInArrow(score, fields + ", score double")
