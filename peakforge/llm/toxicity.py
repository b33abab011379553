"""Toxicity scores: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is an embedding of the word and the average of embeddings of its character n-grams, both hashed. A
window of ``SPAN`` words runs through one recurrent layer in each direction, attention weighs the states, and a linear
layer gives the window's logit. All windows of the whole text, each overlapping the next by a quarter, are scored; a
document's score is a logistic function of its highest logit and its number of windows.

Labels belong to documents, so training picks windows: first those whose words stand out most in toxic documents,
then, epoch by epoch, those that the network itself scores highest. The logistic function is fitted on labelled
documents kept out of the descent.

Defined cases: a null text is an empty one, and a text without words gets the share of toxic labels; null labels and labels of unknown documents are not used; null ids count as the empty text in the split;
repeated rows are scored row by row; an empty table gives no rows, and without labels of both kinds all scores are the share of
toxic labels; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from peakforge.llm.common import crc_mod, written
from peakforge.llm.langid import subwords

SPAN, STEP = 16, 12
NOT_LETTERS = re.compile(r"[\W\d_]+")
GRAMS = 5


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Net:
    """Weights; ``grad`` has their gradients of the last batch, ``past`` the sums of squared ones."""

    buckets: int = 1 << 18
    width: int = 8
    hidden: int = 8
    seed: int = 0
    p: dict = field(default_factory=dict)
    past: dict = field(default_factory=dict)
    scale: tuple[float, float, float] = (-2.0, 1.0, 0.0)  # of the document's logistic function
    known_starts: tuple | None = None
    share: float = 0.0  # of toxic documents, the score of texts without words

    def start(self) -> Net:
        rng, h = np.random.default_rng(self.seed), self.hidden
        normal = lambda *s, sd=0.3: rng.normal(0, sd, s).astype(np.float32)
        self.p = {"words": normal(self.buckets, self.width, sd=0.05), "chars": normal(self.buckets, self.width, sd=0.05)}
        for d in "fb":
            self.p |= {f"W{d}": normal(2 * self.width, 3 * h), f"U{d}": normal(h, 3 * h), f"c{d}": np.zeros(3 * h, np.float32)}
        self.p |= {"A": normal(2 * h, h), "v": normal(h), "o": normal(2 * h), "o0": np.full(1, -1, np.float32)}
        self.past = {k: np.full_like(v, 1e-8) for k, v in self.p.items()}
        return self

    def inputs(self, grams: np.ndarray, counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Input vectors of distinct words."""
        mean = np.add.reduceat(self.p["chars"][grams], np.cumsum(counts) - counts) / counts[:, None]
        return np.concatenate([self.p["words"][whole], mean.astype(np.float32)], 1)

    def run(self, d: str, x: np.ndarray, keep: bool):
        """States of one direction; x: (steps, windows, 3 * hidden), in the order of that direction."""
        h, u = self.hidden, self.p[f"U{d}"]
        state, out, kept = np.zeros((x.shape[1], h), np.float32), [], []
        for t in range(len(x)):
            q = state @ u
            zr = sigmoid(x[t, :, : 2 * h] + q[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(x[t, :, 2 * h :] + r * q[:, 2 * h :])
            new = n + z * (state - n)
            if keep:
                kept.append((state, z, r, n, q[:, 2 * h :]))
            state = new
            out.append(state)
        return np.stack(out), kept

    def logits(self, xf: np.ndarray, xb: np.ndarray, pad: np.ndarray, keep: bool = False):
        """Window logits; xf, xb: (steps, windows, 3 * hidden) projected inputs, pad: (steps, windows)."""
        f, kf = self.run("f", xf, keep)
        b, kb = self.run("b", xb[::-1], keep)
        s = np.concatenate([f, b[::-1]], 2)
        a = np.tanh(s @ self.p["A"])
        e = a @ self.p["v"] - 1e4 * pad
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        pooled = (w[:, :, None] * s).sum(0)
        y = pooled @ self.p["o"] + self.p["o0"]
        return (y, (kf, kb, s, a, w, pooled)) if keep else y

    def project(self, x: np.ndarray) -> np.ndarray:
        """Both directions' projected inputs of words, side by side."""
        return np.concatenate([x @ self.p["Wf"] + self.p["cf"], x @ self.p["Wb"] + self.p["cb"]], 1)

    def project_all(self, words: tuple[np.ndarray, np.ndarray, np.ndarray], part: int = 20_000) -> np.ndarray:
        """Projected inputs of many words, and that of padding as the last row; works part by part to save memory."""
        grams, counts, whole = words
        ends = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty((len(counts) + 1, 6 * self.hidden), np.float32)
        for k in range(0, len(counts), part):
            m = min(k + part, len(counts))
            out[k:m] = self.project(self.inputs(grams[ends[k] : ends[m]], counts[k:m], whole[k:m]))
        out[-1] = self.pad_row()
        return out

    def pad_row(self) -> np.ndarray:
        """Projected input of padding: its update gate is closed, so states pass through."""
        row = np.zeros(6 * self.hidden, np.float32)
        row[: self.hidden] = row[3 * self.hidden : 4 * self.hidden] = 50
        return row

    def starts(self, counts: np.ndarray) -> np.ndarray:
        """Where the n-grams of each word begin; kept, as all steps of a training ask for the same."""
        if self.known_starts is None or self.known_starts[0] is not counts:
            self.known_starts = (counts, np.cumsum(counts) - counts)
        return self.known_starts[1]

    def step(self, words, at: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float) -> None:
        """One step of gradient descent on windows ``at`` (rows of ``words``, -1 for padding) with labels ``y``."""
        grams, counts, whole = words
        used, inv = np.unique(at[at >= 0], return_inverse=True)
        if not len(used):
            return
        starts = self.starts(counts)[used]
        counts, whole = counts[used], whole[used]
        grams = grams[np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())]
        x = self.inputs(grams, counts, whole)
        rows = np.concatenate([self.project(x), self.pad_row()[None]])
        local = np.full(at.shape, len(used))
        local[at >= 0] = inv
        xs = rows[local.T]
        h, pad = self.hidden, (at.T < 0)
        logit, (kf, kb, s, a, w, pooled) = self.logits(xs[:, :, : 3 * h], xs[:, :, 3 * h :], pad, True)
        g = ((sigmoid(logit) - y) * weight / len(y)).astype(np.float32)
        grad = {"o": pooled.T @ g, "o0": g.sum(keepdims=True)}
        dpool = g[:, None] * self.p["o"]
        dw = (s * dpool).sum(2)
        de = w * (dw - (w * dw).sum(0))
        grad["v"] = np.einsum("tbk,tb->k", a, de)
        da = (1 - a * a) * de[:, :, None] * self.p["v"]
        grad["A"] = np.einsum("tbi,tbk->ik", s, da)
        ds = w[:, :, None] * dpool + da @ self.p["A"].T
        dx = np.zeros_like(xs)
        for d, kept, own, to in (("f", kf, ds[:, :, :h], dx[:, :, : 3 * h]), ("b", kb, ds[::-1, :, h:], dx[::-1, :, 3 * h :])):
            u, du, back = self.p[f"U{d}"], np.zeros_like(self.p[f"U{d}"]), np.zeros_like(own[0])
            for t in range(len(kept) - 1, -1, -1):
                state, z, r, n, qn = kept[t]
                back = back + own[t]
                dn = back * (1 - z) * (1 - n * n)
                dz = back * (state - n) * z * (1 - z)
                dr = dn * qn * r * (1 - r)
                to[t] = np.concatenate([dz, dr, dn], 1)
                dq = np.concatenate([dz, dr, dn * r], 1)
                du += state.T @ dq
                back = back * z + dq @ u.T
            grad[f"U{d}"] = du
        per = np.zeros((len(used), 6 * h), np.float32)
        np.add.at(per, inv, dx.transpose(1, 0, 2)[at >= 0])
        dxin = np.zeros_like(x)
        for k, d in enumerate("fb"):
            part = per[:, 3 * h * k : 3 * h * (k + 1)]
            grad[f"W{d}"], grad[f"c{d}"] = x.T @ part, part.sum(0)
            dxin += part @ self.p[f"W{d}"].T
        for k, v in grad.items():
            self.past[k] += v * v
            self.p[k] -= rate * v / np.sqrt(self.past[k])
        for k, ids, v in (("words", whole, dxin[:, : self.width]), ("chars", grams, np.repeat(dxin[:, self.width :] / counts[:, None], counts, 0))):
            rows, back = np.unique(ids, return_inverse=True)
            total = np.zeros((len(rows), self.width), np.float32)
            np.add.at(total, back, v)
            self.past[k][rows] += total * total
            self.p[k][rows] -= rate * total / np.sqrt(self.past[k][rows])

    def document(self, top: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Scores from highest window logits and numbers of windows."""
        a, b, c = self.scale
        return sigmoid(a + b * top + c * np.log(n))


def window_rows(at: np.ndarray, sizes: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows of SPAN word rows, number of windows of each text); ``at`` has the rows of all texts in order."""
    n = np.maximum(1, -(-(sizes - SPAN) // STEP) + 1)
    first = np.repeat(np.cumsum(sizes) - sizes, n)
    end = np.repeat(np.cumsum(sizes), n)
    start = first + STEP * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    pos = start[:, None] + np.arange(SPAN)
    inside = pos < end[:, None]
    return np.where(inside, np.append(at, pad)[np.minimum(pos, len(at))], pad), n


class Reader:
    """Turns texts into rows of projected word inputs; chunks and words seen before are looked up."""

    def __init__(self, net: Net, max_words: int = 300_000):
        self.net, self.max_words = net, max_words
        self._clear()

    def _clear(self) -> None:
        self.chunks: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.rows = self.net.pad_row()[None]  # row 0 is padding
        self.used = 1

    def _learn(self, new: set[str]) -> None:
        plain = {c: NOT_LETTERS.sub("", c.lower()) for c in new}
        fresh = list(set(plain.values()) - self.words.keys())
        if fresh:
            n = self.used + len(fresh)
            if n > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((max(n, 2 * len(self.rows)) - len(self.rows), self.rows.shape[1]), np.float32)])
            for k in range(0, len(fresh), 4096):
                part = fresh[k : k + 4096]
                self.rows[self.used + k : self.used + k + len(part)] = self.net.project(self.net.inputs(*subwords(part, self.net.buckets, GRAMS)))
            self.words.update(zip(fresh, range(self.used, n), strict=True))
            self.used = n
        words = self.words
        self.chunks.update((c, words[w]) for c, w in plain.items())

    def score(self, texts: list[str | None], batch: int = 2048) -> np.ndarray:
        """Document scores."""
        top, n = self.tops(texts, batch)
        wordless = np.array([not t or t.isspace() for t in texts], bool)
        return np.where(wordless, self.net.share, self.net.document(top, n))

    def tops(self, texts: list[str | None], batch: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        if len(self.chunks) > 2 * self.max_words or self.used > self.max_words:
            self._clear()
        chunks = [(t or "").split() for t in texts]
        sizes = np.array([len(c) for c in chunks])
        new = set(itertools.chain.from_iterable(chunks)) - self.chunks.keys()
        if new:
            self._learn(new)
        at = np.fromiter(map(self.chunks.__getitem__, itertools.chain.from_iterable(chunks)), np.int64, int(sizes.sum()))
        windows, n = window_rows(at, sizes, 0)
        out, h = np.empty(len(windows)), 3 * self.net.hidden
        for k in range(0, len(windows), batch):
            w = windows[k : k + batch].T
            x = self.rows[w]
            out[k : k + batch] = self.net.logits(x[:, :, :h], x[:, :, h:], w == 0)
        return np.maximum.reduceat(out, np.cumsum(n) - n) if len(n) else out, n


def train(texts: list[str], labels: list[int], held: list[bool], *, epochs: int = 8, batch: int = 64, rate: float = 0.05, seed: int = 0) -> Net:
    """Fit the network on the texts that are not ``held`` and the document scale on those that are."""
    net, rng = Net(seed=seed).start(), np.random.default_rng(seed)
    y, out = np.array(labels), np.array(held, bool)
    fit = np.flatnonzero(~out)
    share = net.share = float(y.mean()) if len(y) else 0.0
    net.scale = (float(np.log((share + 1e-3) / (1 - share + 1e-3))), 0.0, 0.0)
    if len(set(y[fit])) < 2:
        return net
    index: dict[str, int] = {}
    rows = [np.array([index.setdefault(NOT_LETTERS.sub("", c.lower()), len(index)) for c in texts[k].split()], int) for k in fit]
    listed = list(index)
    parts = [subwords(listed[k : k + 20_000], net.buckets, GRAMS) for k in range(0, len(listed), 20_000)]
    words = grams, counts, _ = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    sizes = np.array([len(r) for r in rows])
    windows, n = window_rows(np.concatenate(rows), sizes, -1)
    windows = windows.astype(np.int32)
    first, yf = np.cumsum(n) - n, y[fit]
    # how much a word stands out: the strongest log ratio of documents of either kind with one of its features
    starts = np.cumsum(counts) - counts
    seen = np.zeros((2, net.buckets))
    for r, k in zip(rows, yf, strict=True):
        u = np.unique(r)
        if len(u):
            flat = np.repeat(starts[u] - np.concatenate([[0], np.cumsum(counts[u])[:-1]]), counts[u]) + np.arange(counts[u].sum())
            seen[k, np.unique(grams[flat])] += 1
    rates = (seen + 1) / (np.bincount(yf, minlength=2)[:, None] + 2)
    strength = np.maximum.reduceat(np.log(rates[1] / rates[0]).astype(np.float32)[grams], starts)
    value = np.append(strength, -9.0)[windows].max(1)
    balance = min(8.0, (yf == 0).sum() / max(1, (yf == 1).sum()))
    for epoch in range(epochs):
        if epoch:
            proj = net.project_all(words)
            h, value = 3 * net.hidden, np.empty(len(windows))
            for k in range(0, len(windows), 4096):
                x = proj[windows[k : k + 4096].T]
                value[k : k + 4096] = net.logits(x[:, :, :h], x[:, :, h:], windows[k : k + 4096].T < 0)
        chosen, kinds = [], []
        for a, m, k in zip(first, n, yf, strict=True):
            best = a + int(np.argmax(value[a : a + m]))
            chosen += [best] if k else [best, int(rng.integers(a, a + m))]
            kinds += [k] if k else [0, 0]
        chosen, kinds = np.array(chosen), np.array(kinds)
        order = rng.permutation(len(chosen))
        for k in range(0, len(order), batch):
            pick = order[k : k + batch]
            net.step(words, windows[chosen[pick]], kinds[pick], np.where(kinds[pick] == 1, balance, 1.0), rate / (1 + 0.3 * epoch))
    test = np.flatnonzero(out) if len(set(y[out])) == 2 and out.sum() >= 20 else np.arange(len(y))
    top, n = Reader(net).tops([texts[k] for k in test])
    net.scale = logistic(np.column_stack([np.ones(len(test)), top, np.log(n)]), y[test])
    return net


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Newton's method for logistic regression with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = np.clip(sigmoid(x @ w), 1e-6, 1 - 1e-6)
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        move = np.linalg.solve(hess, x.T @ (y - p) - ridge * w)
        w += np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-6:
            break
    return tuple(w.tolist())


def sample(docs: DataFrame, labels: DataFrame, toxic_rows: int, other_rows: int, max_chars: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, toxic) of at most so many labelled documents of either label, and how many labels there are of each.

    Rows are chosen by a hash; ids that repeat in ``docs`` or ``labels`` count row by row against the bound. A label holds for
    a whole text, so texts of more than ``max_chars`` code points are left out of the sample, not cut.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    rows = rows.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), 4) != 2)).dropDuplicates()
    total = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}  # two rows
    bound = F.when(F.col("toxic") == 1, toxic_rows).otherwise(other_rows)
    pick = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30))
    share = F.when(F.col("toxic") == 1, 2 * toxic_rows / max(1, total.get(1, 0))).otherwise(2 * other_rows / max(1, total.get(0, 0)))
    chosen = written(rows.withColumn("pick", pick).where(F.col("pick") < share * (1 << 30)), "toxic-sample")  # small, and known to be
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.length("text") <= max_chars)
    order = W.partitionBy("toxic").orderBy("pick", "doc_id", "text")
    got = texts.join(chosen, "doc_id").withColumn("place", F.row_number().over(order))
    most = max(toxic_rows, other_rows)
    return got.where(F.col("place") <= most).where(F.col("place") <= bound).select("doc_id", "text", "toxic"), total


def fit(docs: DataFrame, labels: DataFrame, *, toxic_rows: int = 2000, other_rows: int = 4000, max_chars: int = 40_000, **options) -> Net:
    """A network fitted on a sample of at most so many labelled documents of at most ``max_chars`` code points."""
    got, total = sample(docs, labels, toxic_rows, other_rows, max_chars)
    got = got.toPandas().sort_values(["doc_id", "toxic", "text"])
    held = (got["doc_id"].astype(str).map(lambda s: zlib.crc32(s.encode())) % 4 == 3).tolist()
    net = train(got["text"].tolist(), got["toxic"].tolist(), held, **options)
    return to_share(net, total.get(1, 0) / max(1, sum(total.values())))


def to_share(net: Net, share: float) -> Net:
    """Moves the scores from the sample's share of toxic documents to that of all labelled ones."""
    odds = lambda p: (p + 1e-3) / (1 - p + 1e-3)
    net.scale = (net.scale[0] + float(np.log(odds(share) / odds(net.share))), *net.scale[1:])
    net.share = share
    return net


_READERS: dict[int, Reader] = {}  # one for each worker process, so that its words outlive a task


def score(docs: DataFrame, net: Net) -> DataFrame:
    """(doc_id, score) of every document; only the text is looked at."""
    net.past, net.known_starts = {}, None  # not needed by tasks
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        if id(m) not in _READERS:
            _READERS.clear()
            _READERS[id(m)] = Reader(m)
        reader = _READERS[id(m)]
        for b in batches:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(reader.score(part.column("text").to_pylist()))], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def rate(docs: DataFrame, labels: DataFrame, *, cut: float = 0.3, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    found = score(docs, fit(docs, labels, **options))
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
