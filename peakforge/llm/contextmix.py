"""Scores of texts by online logistic mixing of hashed-context bit predictors.

A text is its words in order, lower-cased in A-Z, and one end. Frequent words (a dictionary of the ``most_symbols`` most frequent of
all training texts) are one symbol; others are their bytes and a space. Symbols are written in Huffman codes, one for symbols that start a word and one for the bytes inside;
every bit is predicted under three contexts: inside a word its last two bytes, its last four and all of it, at a start nothing,
the last two bytes of the word before, and the last one. A context and the place in the code tree are hashed to
a slot of zeros and ones seen in training; the slot's log odds are that predictor's vote. A mixer adds votes by weights that a gate chooses (start or inside; each has a stream of its own), turns the sum into a
probability, and after every ``GROUP`` bits moves the weights down the gradient of the code length. Last, a table that moves towards each bit seen corrects the probability.
Minus the sum of the bits' code lengths is the text's log probability, as the bits name words and end without any doubt.

What is learned comes from all training texts: words are counted first, by one grouping; they give the dictionary, then pairs (end of a word, start of the next) are counted, and
slots are filled from both counts by tasks, whose parts of the tables are summed. The tables have a bounded size (a byte for each slot of ``SLOTS``, 11 MB) and are broadcast.
Weights are not learned before: each stream starts from the constants ``START`` and moves its own.

Mixing runs over lanes: a text's bits are cut into stretches of ``LANE``, each a stream of its own that begins with the starting weights; contexts run on over the cuts. So no text is
too long, and a task holds one chunk of texts at a time.

The base is a smoothed unigram model of all training tokens. The counts of at most ``most_frequent`` words are broadcast; all other words of a text are joined with the counts.

Defined cases: null texts are empty and have the end alone; a null id is the empty text in the hash; repeated rows count as texts; without training texts
every token has the base probability 1, and slots vote for nothing; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakforge.llm.common import crc_mod, written

#: Bits of the slots of each vote; a vote's table serves words' insides and starts, under hashes of their own.
SLOTS = (20, 21, 23)
INSIDE = (2, 4, None)  # bytes of the word so far (None: all)
END = b"\n"
FIRST, WORDS = 256, 512  # symbols: bytes inside a word, first bytes of a word, words of the dictionary
GROUP, LANE, CHUNK = 64, 4096, 300_000
STEP, BINS, REFINE, SCALE = 0.01, 24, 0.02, 12.0
START = ((0.4, 0.4, 0.4), (0.4, 0.4, 0.4))  # weights of the votes of starts and of insides
FAR, LIMIT = 9.0, np.float32(8.99)  # log odds of the mixer go from -FAR to FAR
MOST_HELD, MOST_PAIRS = 200_000, 2_000_000
U = np.uint64
R, R_INV, M1, M2 = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64), 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z in lower case; bytes.split knows exactly the six white-space characters."""
    return (text or "").encode().lower().split()


class Symbols:
    """Words as symbols: a dictionary word is one, others are their bytes and a space. ``counted`` are further words that have a number, but are spelled."""

    def __init__(self, words: list[bytes], counted: list[bytes] = ()) -> None:
        self.words, self.counted = words, [*words, *counted, END]
        self.number = {w: k for k, w in enumerate(self.counted)}
        self.start = np.full(len(self.counted) + 1, -1, np.int64)  # the last entry is that of words without a number
        self.start[: len(words)] = WORDS + np.arange(len(words))
        self.start[len(self.counted) - 1] = FIRST + END[0]
        self.tails = np.zeros(WORDS + len(words), np.int64)
        self.tails[WORDS:] = [tail(w) for w in words]

    def numbers(self, texts: list[list[bytes]]) -> tuple[list[bytes], np.ndarray]:
        """(token, its number or -1) of all texts, each with its end."""
        find = self.number.get
        flat = [w for t in texts for w in (*t, END)]
        return flat, np.array([find(w, -1) for w in flat], np.int64)

    def tokens(self, flat: list[bytes], number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start symbol, tail of the token before, length of a spelled word or 0) by token, and (bytes, first byte's place) of spelled words."""
        start = self.start[number]
        spelled = np.flatnonzero(start < 0)
        own = [flat[k] for k in spelled]
        data = np.frombuffer(b" ".join((*own, b"")), np.uint8)
        size = np.array([len(w) for w in own], np.int64)
        at = np.cumsum(size + 1) - size - 1
        length = np.zeros(len(flat), np.int64)
        length[spelled] = size
        tails = self.tails[np.maximum(start, 0)]
        if len(own):
            last = at + size - 1
            tails[spelled] = data[last].astype(np.int64) + 1 + np.where(size > 1, (data[np.maximum(last - 1, 0)].astype(np.int64) + 1) * 257, 0)
            start[spelled] = FIRST + data[at].astype(np.int64)
        before = np.concatenate([[0], tails[:-1]])  # an end has no tail, so a text begins after nothing
        return start, before, length, data, at


def tail(word: bytes) -> int:
    """A number for the last two bytes of a word; modulo 257 it is one for the last."""
    return word[-1] + 1 + (word[-2] + 1) * 257 if len(word) > 1 else word[-1] + 1


# --- counts ---------------------------------------------------------------------------------------------------


def word_counts(texts: DataFrame) -> DataFrame:
    """(key, n) of the words and ends of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["key", "n"])

        for b in batches:
            for t in b.column(0):
                held.update(words_of(t.as_py()))
                if len(held) > MOST_HELD:
                    yield told()
                    held.clear()
            if b.num_rows:
                held[END] += b.num_rows
        yield told()

    return texts.mapInArrow(run, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))


def byte_counts(words: DataFrame) -> DataFrame:
    """(byte, n) of the bytes inside words, the space after each counted, from the counts (key, n) of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FIRST)
        for b in batches:
            n = b.column(1).to_numpy(zero_copy_only=False)
            keys = b.column(0).to_pylist()
            total += np.bincount(np.frombuffer(b" ".join((*(k[1:] for k in keys), b"")), np.uint8), np.repeat(n, [len(k) for k in keys]), FIRST)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FIRST)), pa.array(total.astype(np.int64))], ["byte", "n"])

    return words.mapInArrow(run, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n"))


def pair_counts(texts: DataFrame, symbols: list[bytes]) -> DataFrame:
    """(key, n) of the pairs (tail of a token, start symbol of the next) of all texts."""
    sent = texts.sparkSession.sparkContext.broadcast(symbols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, pairs = Symbols(sent.value), []

        def told() -> Iterator[pa.RecordBatch]:
            if pairs:
                key, n = np.unique(np.concatenate(pairs), return_counts=True)
                pairs.clear()
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

        for b in batches:
            for some in chunks(words_of(t.as_py()) for t in b.column(0)):
                start, before, *_ = made.tokens(*made.numbers(some))
                pairs.append(before << 32 | start)
                if sum(map(len, pairs)) > MOST_PAIRS:
                    yield from told()
        yield from told()

    return texts.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


# --- bits -----------------------------------------------------------------------------------------------------


class Code:
    """Huffman codes of symbols: for each one its bits and the tree nodes at which they are decided, in flat arrays."""

    def __init__(self, counts: np.ndarray) -> None:
        paths = self.tree(counts[:FIRST], 0) + self.tree(counts[FIRST:], 1 << 24)
        self.size = np.array([len(p) for p in paths])
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        with np.errstate(over="ignore"):
            self.node = np.array([n for p in paths for n, _ in p], np.uint32) * np.uint32(0x85EBCA6B)
        self.bit = np.array([b for p in paths for _, b in p], np.int8)

    @staticmethod
    def tree(counts: np.ndarray, base: int) -> list[list[tuple[int, int]]]:
        heap = [(int(c) + 1, b) for b, c in enumerate(counts)]
        heapq.heapify(heap)
        above: dict[int, tuple[int, int]] = {}
        for inner in range(len(counts), 2 * len(counts) - 1):
            (n0, zero), (n1, one) = heapq.heappop(heap), heapq.heappop(heap)
            above[zero], above[one] = (inner, 0), (inner, 1)
            heapq.heappush(heap, (n0 + n1, inner))
        paths = []
        for at in range(len(counts)):
            path = []
            while at in above:
                at, bit = above[at]
                path.append((base + at, bit))
            paths.append(path[::-1])
        return paths

    def places(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the symbol, place in ``node`` and ``bit``) for every bit."""
        size = self.size[symbol]
        of = np.repeat(np.arange(len(symbol), dtype=np.int32), size)
        return of, np.arange(len(of), dtype=np.int32) + np.repeat((self.first[symbol] - np.cumsum(size) + size).astype(np.int32), size)


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def inside_hashes(data: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """32 bits of each context of the bytes inside words: ``start`` is where a byte's word starts."""
    with np.errstate(over="ignore"):
        n = len(data)
        up, down = powers(n, R), powers(n, R_INV)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + U(1)) * up[:n])])
        at = np.arange(n)
        out = []
        for k in INSIDE:
            low = start if k is None else np.maximum(start, at - k)
            out.append(mixed((sums[:-1] - sums[low]) * down[low] + (low == start) * U(M2)))
        return out


def start_hashes(before: np.ndarray) -> list[np.ndarray]:
    """32 bits of each context of a start symbol after a token of this tail."""
    tails = before.astype(np.uint64)
    with np.errstate(over="ignore"):
        return [mixed(np.full(len(tails), M1, np.uint64)), mixed(tails * U(3) + U(1)), mixed(tails % U(257) * U(5) + U(2))]


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(29))) * U(R)
        return (((h ^ (h >> U(32))) * U(M2)) >> U(32)).astype(np.uint32)


def slots(hash_: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    """Slots of a context's bits: its hash and the node, mixed in 32 bits."""
    with np.errstate(over="ignore"):
        return ((hash_ + node) * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)


# --- tables ---------------------------------------------------------------------------------------------------


def add_bits(zeros_ones: list[np.ndarray], code: Code, symbol: np.ndarray, hashes: list[np.ndarray], n: np.ndarray) -> None:
    """Add the bits of symbols that occur ``n`` times under contexts of these hashes to (bit, slot) of each vote."""
    of, at = code.places(symbol)
    node, bit, weight = code.node[at], code.bit[at], n.astype(np.float32)[of]
    for table, h, bits in zip(zeros_ones, hashes, SLOTS, strict=True):
        where = slots(h[of], node, bits).astype(np.int64) + (bit.astype(np.int64) << bits)
        np.add.at(table.reshape(-1), where, weight)


def add_words(zeros_ones: list[np.ndarray], code: Code, words: list[bytes], n: np.ndarray) -> None:
    """Add the bits inside spelled words."""
    size = np.array([len(w) + 1 for w in words])
    first = np.cumsum(size) - size
    data = np.frombuffer(b" ".join((*words, b"")), np.uint8)
    hashes = inside_hashes(data, np.repeat(first, size))
    inside = np.ones(len(data), bool)
    inside[first] = False
    add_bits(zeros_ones, code, data[inside].astype(np.int64), [h[inside] for h in hashes], np.repeat(n, size - 1))


def add_pairs(zeros_ones: list[np.ndarray], code: Code, pair: np.ndarray, n: np.ndarray) -> None:
    """Add the bits of start symbols after tails."""
    add_bits(zeros_ones, code, pair & 0xFFFFFFFF, start_hashes(pair >> 32), n)


def votes(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log odds of slots in steps of 1 / SCALE, in a byte."""
    return np.clip(np.rint(np.log((ones + 0.3) / (zeros + 0.3)) * SCALE), -127, 127).astype(np.int8)


def tables(words: DataFrame, pairs: DataFrame, code: Code, symbols: list[bytes], tasks: int, part: int = 1 << 15) -> list[np.ndarray]:
    """Votes by slot, from the counts (key, n) of words and pairs."""
    sent = words.sparkSession.sparkContext.broadcast((code, set(symbols) | {END}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, spelled = sent.value
        made = [np.zeros((2, 1 << b), np.float32) for b in SLOTS]
        for b in batches:
            words, n = b.column(0).to_pylist(), b.column(2).to_numpy(zero_copy_only=False)
            pair = b.column(1).fill_null(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(words), 20_000):
                some = range(at, min(at + 20_000, len(words)))
                own = [k for k in some if words[k] is not None and words[k] not in spelled]
                if own:
                    add_words(made, code, [words[k] for k in own], n[own])
                own = [k for k in some if words[k] is None]
                if own:
                    add_pairs(made, code, pair[own], n[own])
        pack = zstandard.ZstdCompressor(level=1)
        for c, whole in enumerate(made):
            for at in range(0, whole.shape[1], part):
                x = whole[:, at : at + part]
                if x.any():
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([at], pa.int32()), pa.array([pack.compress(x.tobytes())])], ["vote", "at", "packed"])

    def merge(keys: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, part))
        unpack = zstandard.ZstdDecompressor()
        for frame in parts:
            for p in frame["packed"]:
                total += np.frombuffer(unpack.decompress(p), np.float32).reshape(2, -1)
        yield pd.DataFrame({"vote": [keys[0]], "at": [keys[1]], "votes": [votes(*total).tobytes()]})

    counts = words.select("key", F.lit(None).cast("long").alias("pair"), "n").unionByName(pairs.select(F.lit(None).cast("binary").alias("key"), F.col("key").alias("pair"), "n"))
    filled = counts.repartition(tasks).mapInArrow(run, "vote int, at int, packed binary")
    out = [np.zeros(1 << b, np.int8) for b in SLOTS]
    for row in filled.groupBy("vote", "at").applyInPandas(merge, "vote int, at int, votes binary").collect():  # a byte for each slot at most
        out[row["vote"]][row["at"] : row["at"] + part] = np.frombuffer(row["votes"], np.int8)
    return out


# --- mixing ---------------------------------------------------------------------------------------------------


class Mixer:
    """Code lengths of texts under tables of votes."""

    def __init__(self, symbols: Symbols, code: Code, table: list[np.ndarray], weights: np.ndarray | None = None) -> None:
        self.symbols, self.code, self.table = symbols, code, table
        self.weights = np.array(START, np.float32) if weights is None else weights

    def stream(self, texts: list[list[bytes]], flat: list[bytes], number: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """(symbol, hash of each context, symbols of each text)."""
        start, before, length, data, at = self.symbols.tokens(flat, number)
        size = 1 + length
        places = np.cumsum(size) - size
        starts = np.zeros(int(size.sum()), bool)
        starts[places] = True
        symbol = np.empty(len(starts), np.int64)
        symbol[places] = start
        hashes = [np.empty(len(starts), np.uint32) for _ in SLOTS]
        for h, own in zip(hashes, start_hashes(before), strict=True):
            h[places] = own
        if len(data):
            inside = np.ones(len(data), bool)
            inside[at] = False
            within = length[length > 0] + 1
            symbol[~starts] = data[inside]
            for h, own in zip(hashes, inside_hashes(data, np.repeat(at, within)), strict=True):
                h[~starts] = own[inside]
        tokens = np.cumsum([len(t) + 1 for t in texts])
        return symbol, hashes, np.diff(np.concatenate([[0], np.cumsum(size)[tokens - 1]]))

    def run(self, texts: list[list[bytes]], flat: list[bytes], number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bits of each text; for starts and insides the weights at the end of lanes, summed, and the number of lanes)."""
        symbol, hashes, n_symbols = self.stream(texts, flat, number)
        # the gate parts a text into two streams, starts and insides, which share nothing but the text
        stream = np.repeat(2 * np.arange(len(texts)), n_symbols) + (symbol < FIRST)
        order = np.argsort(stream, kind="stable")
        symbol, stream, hashes = symbol[order], stream[order], [h[order] for h in hashes]
        of, place = self.code.places(symbol)
        size = np.bincount(stream, weights=self.code.size[symbol], minlength=2 * len(texts)).astype(np.int64)
        begin = np.cumsum(size) - size
        lanes = -(-size // LANE)
        start = np.repeat(begin, lanes) + (np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        length = np.minimum(LANE, np.repeat(begin + size, lanes) - start)
        owner = np.repeat(np.arange(2 * len(texts)), lanes)
        order = np.argsort(-length, kind="stable")  # lanes that go on stand before those that end
        start, length, owner = start[order], length[order], owner[order]
        count, steps = len(start), -(-int(length[0]) // GROUP)
        active = np.searchsorted(-length, -np.arange(steps) * GROUP, side="left")
        # Bits in the order (step, lane, bit of the group): what a step reads lies together. A group beyond its lane's end repeats the lane's first bit and is masked.
        first = np.concatenate([[0], np.cumsum(active)]) * GROUP
        start32, last = start.astype(np.int32)[:, None], (length - 1).astype(np.int32)[:, None]
        source = np.concatenate([(start32[:m] + np.minimum(np.arange(t * GROUP, (t + 1) * GROUP, dtype=np.int32), last[:m])).reshape(-1) for t, m in enumerate(active)])
        of, place = of[source], place[source]
        node, bits = self.code.node[place], self.code.bit[place] == 1
        votes_ = np.stack([np.take(t, slots(h[of], node, b)) for t, h, b in zip(self.table, hashes, SLOTS, strict=True)])
        w = self.weights[owner % 2]
        centre = ((np.arange(BINS) - (BINS - 1) / 2) * (2 * FAR / BINS)).astype(np.float32)
        apm = np.tile((1 / (1 + np.exp(-centre))).astype(np.float32), count)
        told = np.zeros(count)
        of_bin = (np.arange(count) * BINS + BINS // 2)[:, None]
        one, unit, per_bin, step = np.float32(1), np.float32(1 / SCALE), np.float32(BINS / (2 * FAR)), np.float32(STEP / SCALE)
        for t, m in enumerate(active):
            part = slice(first[t], first[t + 1])
            v = votes_[:, part].reshape(-1, m, GROUP).astype(np.float32)
            hit = bits[part].reshape(m, GROUP)
            z = np.einsum("mk,kmg->mg", w[:m], v)
            z *= unit
            np.minimum(np.maximum(z, -LIMIT, out=z), LIMIT, out=z)
            p = one / (one + np.exp(-z))
            cell = np.floor(z * per_bin).astype(np.int64) + of_bin[:m]
            refined = apm[cell]
            likely = np.float32(0.75) * p + np.float32(0.25) * refined
            right = np.where(hit, likely, one - likely)
            err = (hit - p) * step
            move = (hit - refined) * np.float32(REFINE)
            if length[m - 1] < (t + 1) * GROUP:  # some lanes end inside this group
                ended = np.arange(t * GROUP, (t + 1) * GROUP) >= length[:m, None]
                right[ended], err[ended], move[ended] = 1, 0, 0
            told[:m] -= np.log2(np.multiply.reduce(right, axis=1, dtype=np.float64))
            w[:m] += np.einsum("mg,kmg->mk", err, v)
            apm[cell] = refined + move
        ends = np.array([np.append(w[owner % 2 == k].sum(0), (owner % 2 == k).sum()) for k in (0, 1)])
        return np.bincount(owner // 2, weights=told, minlength=len(texts)), ends


def chunks(texts: Iterator[list[bytes]], most: int = CHUNK) -> Iterator[list[list[bytes]]]:
    """Texts in lists of about ``most`` bytes."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += sum(map(len, t)) + len(t) + 1
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


# --- the operator ---------------------------------------------------------------------------------------------


def fitted(docs: DataFrame, *, most_symbols: int, most_frequent: int) -> tuple[DataFrame, int, int, tuple]:
    """(counts of words, training tokens, different ones, what tasks need) of the training part of ``docs``."""
    train = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(crc_mod(F.col("doc_id"), 5) != 1).select("text")
    words = written(word_counts(train), "mix-words")
    ends = F.coalesce(F.sum(F.when(F.col("key") == F.lit(END), F.col("n"))), F.lit(0))
    different, tokens, n_texts = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), ends).first()
    frequent = {bytes(r["key"]): r["n"] for r in words.orderBy(F.desc("n"), "key").limit(max(most_frequent, most_symbols + 1)).collect()}
    symbols = [w for w, n in frequent.items() if w != END and n > 1][:most_symbols]
    counts = np.zeros(WORDS + len(symbols), np.int64)
    for r in byte_counts(words.where(F.col("key") != F.lit(END))).collect():  # a row for each byte
        counts[r["byte"]] = r["n"]
    for w in symbols:  # these are not spelled
        counts[:FIRST] -= np.bincount(np.frombuffer(w[1:] + b" ", np.uint8), minlength=FIRST) * frequent[w]
    pairs = written(pair_counts(train, symbols), "mix-pairs")
    n_pairs = 0
    symbol = F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("symbol")
    for r in pairs.groupBy(symbol).agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect():  # a row for each symbol
        counts[r["symbol"]] = r["n"]
        n_pairs += r["rows"]
    code = Code(counts)
    table = tables(words, pairs, code, symbols, max(4, min(1024, (different + n_pairs) // 1_500_000)))
    n_of = dict(list(frequent.items())[:most_frequent])
    n_of[END] = n_texts
    known = Symbols(symbols, list(n_of.keys() - set(symbols) - {END}))
    n = np.array([*(n_of.get(w, -1) for w in known.counted), -1])  # of -1 the count is not at hand
    return words, tokens, different, (known, n, Mixer(known, code, table))


def score_texts(docs: DataFrame, *, most_symbols: int = 1 << 15, most_frequent: int = 1 << 17) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits, bytes, bits_per_byte) of every text of ``docs``.

    ``most_symbols`` bounds the dictionary, ``most_frequent`` the counts that are broadcast. All counts are those of all training texts.
    """
    from pyspark import TaskContext

    spark = docs.sparkSession
    words, n_all, n_different, model = fitted(docs, most_symbols=most_symbols, most_frequent=most_frequent)
    sent = spark.sparkContext.broadcast(model)
    norm = math.log10(n_all + 0.5 * (n_different + 1))
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "bits", "bytes", "rest"]
    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, bits double, bytes long, rest array<struct<key: binary, k: long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, mixer = sent.value
        logs = np.log10(np.maximum(n, 0) + 0.5) - norm
        rows: list[tuple] = []
        at = TaskContext.get().partitionId() << 40

        def texts() -> Iterator[list[bytes]]:
            for b in batches:
                for doc_id, held_out, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                    own = words_of(text.as_py())
                    rows.append((doc_id, held_out, sum(map(len, own)) + len(own)))
                    yield own

        for some in chunks(texts()):
            flat, number = known.numbers(some)
            bits, _ = mixer.run(some, flat, number)
            size = np.array([len(t) + 1 for t in some])
            of = np.repeat(np.arange(len(some)), size)
            told = n[number] >= 0
            base = np.bincount(of, weights=np.where(told, logs[number], 0.0), minlength=len(some))
            seen = np.bincount(of, weights=told & (n[number] > 0), minlength=len(some)).astype(np.int64)
            left = np.flatnonzero(~told)
            rest = Counter(zip(of[left].tolist(), [flat[k] for k in left], strict=True))  # in the order of texts
            ends = np.concatenate([[0], np.cumsum(np.bincount(np.array([t for t, _ in rest], np.int64), minlength=len(some)))])
            pairs = pa.StructArray.from_arrays([pa.array([w for _, w in rest], pa.binary()), pa.array(list(rest.values()), pa.int64())], ["key", "k"])
            own, rows[:] = rows[: len(some)], rows[len(some) :]
            columns = [at + np.arange(len(some)), *([r[k] for r in own] for k in (0, 1)), size, seen, base, bits, [r[2] for r in own]]
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], names)
            at += len(some)

    held_out = crc_mod(F.col("doc_id"), 5) == 1
    scored = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema), "mix-scored")
    rare = scored.select("row", F.explode("rest").alias("t")).select("row", "t.key", "t.k").join(words, "key", "left").select("row", "k", F.coalesce("n", F.lit(0)).alias("n"))
    log = F.log10(F.col("n") + F.lit(0.5)) - F.lit(norm)
    rare = rare.groupBy("row").agg(F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("more"), F.sum(F.col("k") * log).alias("far"))
    whole = scored.drop("rest").join(rare, "row", "left")
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("far", F.lit(0.0))).alias("base_score"), (-F.col("bits") * F.lit(math.log10(2))).alias("score"), "bits", "bytes", (F.col("bits") / F.greatest("bytes", F.lit(1))).alias("bits_per_byte"),
    )
