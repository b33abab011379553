"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's features are the letter n-grams of its words and the words themselves, hashed to ``buckets`` rows of an
embedding; their average over the whole text goes through a linear layer and a softmax. Both are trained in numpy by
stochastic gradient descent on pieces of labelled texts. Logits are then scaled by one temperature, fitted on
labelled texts kept out of the descent, and texts whose scaled confidence lies below a threshold set on the same texts
are rejected. The number of languages is not bounded by the code; the driver holds ``per_lang`` * ``max_chars`` code points of each.

As the layer is linear, a word adds the same vector to the logits wherever it stands, so tasks look up words seen
before; that table is emptied at a fixed size.

Defined cases: a text that is null or has no letters is ``und`` with score 0 and is rejected; null labels are not
learned from; null ids count as the empty text in the split; repeated rows are predicted row by row; an empty table, or
one without labels, gives ``und`` throughout; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from peakforge.llm.common import crc_mod, free_name, written

LETTERS = re.compile(r"[^\W\d_]+")
UND = "und"


def letter_runs(text: str) -> list[str]:
    """The maximal runs of letters of a text in lower case. Beside them \\w holds numerals that are no decimal digits (superscripts, fractions, Roman ones): words with such are parted."""
    words = LETTERS.findall(text.lower())
    if text.isascii() or all(map(str.isalpha, words)):
        return words
    return [run for w in words for run in "".join(c if c.isalpha() else " " for c in w).split()]


def subwords(words: list[str], buckets: int, longest: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed rows of lower-case words: those of all n-grams, the number of n-grams of each word, and those of the words.

    N-grams run up to ``longest`` code points, with marks at both ends of a word; rows come from polynomial hashes.
    """
    text = "".join(f"<{w}>" for w in words)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], int)
    first = np.cumsum(size) - size
    left = np.repeat(first + size, size) - np.arange(len(c))  # code points from here to the end of the word
    prime, h = np.uint64(0x9E3779B97F4A7C15), np.zeros(len(c), np.uint64)
    grams = np.full((len(c), longest), -1, np.int32)
    for n in range(1, min(longest, len(c)) + 1):
        h = h[: len(c) - n + 1] * prime + c[n - 1 :] + np.uint64(n)
        grams[: len(h), n - 1] = np.where(left[: len(h)] >= n, _row(h, buckets), -1)
    if not words:
        return grams.ravel(), size, size
    power = np.multiply.accumulate(np.full(int(size.max()), prime))
    whole = np.add.reduceat(c * power[np.arange(len(c)) - np.repeat(first, size)], first)
    return grams[grams >= 0], np.add.reduceat((grams >= 0).sum(1), first), _row(whole, buckets)


def _row(h: np.ndarray, buckets: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # what each row adds to the logits
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, total: np.ndarray, n: np.ndarray) -> np.ndarray:
        return total / np.maximum(n, 1)[:, None] + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


class Scorer:
    """Sums of logits over the words of texts; chunks between white space are looked up."""

    def __init__(self, model: Model, max_chunks: int = 500_000):
        self.model, self.max_chunks = model, max_chunks
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(model.langs) + 1))

    def _learn(self, chunks: list[str]) -> None:
        before = len(self.known)
        while before + len(chunks) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(4096, len(self.rows)), self.rows.shape[1]))])
        self.rows[before : before + len(chunks)] = 0
        self.known.update(zip(chunks, range(before, before + len(chunks)), strict=True))
        words, of = [], []
        for k, chunk in enumerate(chunks, before):
            for w in letter_runs(chunk):
                words.append(w)
                of.append(k)
        if words:
            grams, counts, whole = subwords(words, len(self.model.table))
            sums = np.add.reduceat(self.model.table[grams], np.cumsum(counts) - counts) + self.model.table[whole]
            np.add.at(self.rows, np.array(of), np.column_stack([sums, counts + 1]))

    def totals(self, texts: list[str | None], group: int = 200) -> np.ndarray:
        """For each text the sum of its words' logits and, last, its number of features."""
        return np.concatenate([self._totals(texts[k : k + group]) for k in range(0, len(texts), group)] or [self._totals([])])

    def _totals(self, texts: list[str | None]) -> np.ndarray:
        if len(self.known) > self.max_chunks:
            self.known = {}
        chunks = [(t or "").split() for t in texts]
        sizes = [len(c) for c in chunks]
        new = set(itertools.chain.from_iterable(chunks)) - self.known.keys()
        if new:
            self._learn(list(new))
        at, ends = list(map(self.known.__getitem__, itertools.chain.from_iterable(chunks))), np.cumsum(sizes)
        out = np.zeros((len(texts), self.rows.shape[1]))
        some = np.flatnonzero(sizes)
        if len(some):
            out[some] = np.add.reduceat(self.rows[at], (ends - sizes)[some])
        return out


def train(
    texts: list[str], langs: list[str], held: list[bool], *, buckets: int = 1 << 16, dim: int = 16, epochs: int = 2, rate: float = 0.5, seed: int = 0, max_loss: float = 0.001
) -> Model:
    """Fit on the texts that are not ``held``; temperature and threshold on those that are.

    The threshold rejects at most ``max_loss`` of the held texts that are predicted right, and never a text with a
    confidence of a half or more.
    """
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    def pieces(text: str) -> Iterator[np.ndarray]:
        words = letter_runs(text)
        at = 0
        while at < len(words):
            n = (3, 8, 20, 60, 200)[int(rng.integers(5))]
            grams, _, whole = subwords(words[at : at + n], buckets)
            yield np.concatenate([grams, whole])
            at += n

    data = [(p, names.index(lang)) for t, lang, h in zip(texts, langs, held, strict=True) if not h for p in pieces(t)]
    emb = rng.normal(0, 0.1, (buckets, dim))
    out, bias = rng.normal(0, 0.1, (dim, len(names))), np.zeros(len(names))
    steps, done = max(1, epochs * len(data)), 0
    share = np.bincount([y for _, y in data], minlength=len(names)) / max(1, len(data))
    weight = 1 / np.maximum(share * len(names), 1e-3)
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            ids, y = data[k]
            lr = rate * (1 - done / steps)
            done += 1
            h = emb[ids].mean(0)
            z = h @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            p *= min(weight[y], 10.0)
            back = out @ p
            out -= lr * np.outer(h, p)
            bias -= lr * p
            np.subtract.at(emb, ids, lr * back / len(ids) * 20)  # an average moves each row by 1/len; the factor makes up for part of it
    model = Model(names, emb @ out, bias)
    test = [(t, names.index(lang)) for t, lang, h in zip(texts, langs, held, strict=True) if h]
    sums, y = Scorer(model).totals([t for t, _ in test]), np.array([y for _, y in test], int)
    sums, y = sums[sums[:, -1] > 0], y[sums[:, -1] > 0]
    if len(y):
        logits = model.logits(sums[:, :-1], sums[:, -1])
        losses = {}
        for t in np.geomspace(0.05, 5, 60):
            model.temperature = float(t)
            losses[float(t)] = -np.log(model.probabilities(logits)[np.arange(len(y)), y] + 1e-12).mean()
        model.temperature = min(losses, key=losses.get)
        p = model.probabilities(logits)
        right = p.max(1)[p.argmax(1) == y]
        model.threshold = float(min(0.5, np.quantile(right, max_loss))) if len(right) else 0.0
    return model


def sample(docs: DataFrame, per_lang: int, max_chars: int) -> DataFrame:
    """At most ``per_lang`` labelled training rows (text, lang, held) of each language, chosen by a hash of id and text.

    Of a text with more than ``max_chars`` code points a passage of that length is taken, from a place that the hash chooses.
    The bound is exact, whatever repeats: a first cut by the hash leaves about twice as many, their order by the hash the rest.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod(F.col("doc_id"), 5) != 0))
    counts = written(rows.groupBy("lang").agg(F.count("*").alias("lang_rows")), "lid-counts")  # small, and known to be
    rows = rows.withColumn("pick", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)))
    likely = rows.join(counts, "lang").where(F.col("pick") < 2 * per_lang / F.col("lang_rows") * (1 << 30))
    at = F.pmod(F.col("pick"), F.greatest(F.length("text") - max_chars, F.lit(0)) + 1).cast("int") + 1
    passage = likely.withColumn("text", F.when(F.length("text") > max_chars, F.substring(F.col("text"), at, F.lit(max_chars))).otherwise(F.col("text")))
    order = W.partitionBy("lang").orderBy("pick", "doc_id", "text")
    first = passage.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_lang)
    return first.select("text", "lang", (crc_mod(F.col("doc_id"), 5) == 1).alias("held"))


def fit(docs: DataFrame, *, per_lang: int = 300, max_chars: int = 20_000, **options) -> Model | None:
    """A model fitted on at most ``per_lang`` texts of at most ``max_chars`` code points a language; None if no row has a label."""
    rows = sample(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"), F.col("lang").cast("string")), per_lang, max_chars).toPandas()
    if rows.empty:
        return None
    rows = rows.sort_values(["lang", "text"])
    return train(rows["text"].tolist(), rows["lang"].tolist(), rows["held"].tolist(), **options)


_SCORERS: dict[int, Scorer] = {}  # one for each worker process, so that its words outlive a task


def predict(docs: DataFrame, model: Model | None, prefix: str = "") -> DataFrame:
    """``docs`` with lang_pred, score and rejected, their names after ``prefix``; only the text is looked at.

    Underscores follow a name that ``docs`` has already.
    """
    extra = [free_name(docs, prefix + c) for c in ("lang_pred", "score", "rejected")]
    schema = docs.select(*docs.columns, *(F.lit(v).alias(c) for c, v in zip(extra, ("", 0.0, True), strict=True))).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        if m and id(m) not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[id(m)] = Scorer(m)
        scorer = m and _SCORERS[id(m)]
        for b in batches:
            text = b.column("text")
            names, scores, bad = [UND] * b.num_rows, np.zeros(b.num_rows), np.ones(b.num_rows, bool)
            if m and b.num_rows:
                sums = scorer.totals(text.to_pylist())
                p = m.probabilities(m.logits(sums[:, :-1], sums[:, -1]))
                some = sums[:, -1] > 0
                best = p.argmax(1)
                names = [m.langs[k] if s else UND for k, s in zip(best, some, strict=True)]
                scores = np.where(some, p.max(1), 0.0)
                bad = ~some | (p.max(1) < m.threshold)
            cols = [*b.columns, pa.array(names, pa.string()), pa.array(scores), pa.array(bad)]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, *extra])

    return docs.mapInArrow(run, schema)


def confident(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with their own columns alone."""
    found = predict(docs, model)
    return found.where(~F.col(f"`{found.columns[-1]}`")).select(*(F.col(f"`{c}`") for c in docs.columns))


def identify(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = predict(rows, fit(docs, **options))
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")
