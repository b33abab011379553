import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from peakforge.llm import contextmix as M


def some_docs(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("thenrédao") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    weights = [1 / (k + 1) for k in range(len(words))]
    docs = [(k // 2 if k % 9 else None, " ".join(w.title() if rng.random() < 0.1 else w for w in rng.choices(words, weights, k=rng.randrange(1, 120)))) for k in range(n)]
    return [*docs, (7, None), (8, ""), (9, " \t\n"), (11, "ÀB c d x"), (12, "z" * 9000), (12, " ".join(f"w{k}" for k in range(4000)))]


def base(docs):
    """The unigram model from plain loops: what it says of each text."""
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), None]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    c = Counter(w for d, t in docs if not held(d) for w in words(t))
    n, v = sum(c.values()), len(c)
    return [(d, held(d), len(words(t)), sum(w in c for w in words(t)), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t))) for d, t in docs]


def table(spark, docs):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, row string, n long")


@pytest.mark.parametrize("frequent", [1 << 17, 5])
def test_base_equals_brute_force(spark, frequent):
    docs = some_docs(1, 400)
    got = M.score_texts(table(spark, docs), most_frequent=frequent, most_symbols=40).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], round(r[5], 4))
    for g, w in zip(sorted(got, key=key), sorted(base(docs), key=key), strict=True):
        assert tuple(g)[:5] == w[:5]
        assert g["base_score"] == pytest.approx(w[5], abs=1e-6)
        assert g["score"] < 0 and math.isfinite(g["score"]) and g["bits"] == pytest.approx(-g["score"] / math.log10(2))


def test_model_is_better_than_its_order_zero_code(spark):
    """Held-out text costs fewer bits than under the base, and fewer than the code lengths alone."""
    docs = some_docs(2, 1500)
    got = [r for r in M.score_texts(table(spark, docs)).collect() if r["held_out"] and 20 < r["n_tokens"] < 1000]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def mixer():
    rng = np.random.default_rng(1)
    symbols = M.Symbols([b"the", b"of"], [b"rare"])
    code = M.Code(np.concatenate([rng.integers(1, 99, M.WORDS), [500, 300]]))
    return M.Mixer(symbols, code, [rng.integers(-60, 60, 1 << b).astype(np.int8) for b in M.SLOTS])


def by_bits(m, text):
    """The bits of one text in plain loops and whole numbers: starts and insides, each one group after another; a stream of LANE bits begins anew."""
    mask = (1 << 64) - 1

    def mixed(h):
        h = ((h ^ (h >> 29)) * M.R) & mask
        return (((h ^ (h >> 32)) * M.M2) & mask) >> 32

    def spelled(part):
        return sum((b + 1) * pow(M.R, k, 1 << 64) for k, b in enumerate(part)) & mask

    line, before = [], 0
    for w in (*text, M.END):
        start = [mixed(M.M1), mixed(before * 3 + 1), mixed(before % 257 * 5 + 2)]
        k = m.symbols.number.get(w, -1)
        symbol = M.FIRST + w[0] if m.symbols.start[k] < 0 else int(m.symbols.start[k])
        line.append((symbol, start, 0))
        if m.symbols.start[k] < 0:
            whole = w + b" "
            for i in range(1, len(whole)):
                lows = [0 if n is None else max(0, i - n) for n in M.INSIDE]
                line.append((whole[i], [mixed((spelled(whole[low:i]) + (low == 0) * M.M2) & mask) for low in lows], 1))
        before = 0 if w == M.END else M.tail(w)
    bits = []
    for symbol, hashes, kind in line:
        for at in range(m.code.first[symbol], m.code.first[symbol + 1]):
            where = [(((h + int(m.code.node[at])) & 0xFFFFFFFF) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - b) for h, b in zip(hashes, M.SLOTS, strict=True)]
            bits.append(([float(t[x]) for t, x in zip(m.table, where, strict=True)], int(m.code.bit[at]), kind))
    return sum(one_stream(m, [b for b in bits if b[2] == kind]) for kind in (0, 1))


def one_stream(m, bits):
    total = 0.0
    for lane in range(0, len(bits), M.LANE):
        w = [list(map(float, x)) for x in m.weights]
        apm = [1 / (1 + math.exp(-(k - (M.BINS - 1) / 2) * 2 * M.FAR / M.BINS)) for k in range(M.BINS)]
        for at in range(lane, min(lane + M.LANE, len(bits)), M.GROUP):
            moves, put = [], {}
            for v, bit, kind in bits[at : min(at + M.GROUP, lane + M.LANE)]:
                z = max(-8.99, min(8.99, sum(a * b for a, b in zip(w[kind], v, strict=True)) / M.SCALE))
                p = 1 / (1 + math.exp(-z))
                cell = math.floor(z * M.BINS / (2 * M.FAR)) + M.BINS // 2
                likely = 0.75 * p + 0.25 * apm[cell]
                total -= math.log2(likely if bit else 1 - likely)
                moves.append((kind, (bit - p) * M.STEP / M.SCALE, v))
                put[cell] = apm[cell] + (bit - apm[cell]) * M.REFINE
            for kind, e, v in moves:
                for k, x in enumerate(v):
                    w[kind][k] += e * x
            for cell, x in put.items():
                apm[cell] = x
    return total


def test_mixing_equals_plain_loops(monkeypatch):
    monkeypatch.setattr(M, "LANE", 64)
    m, rng = mixer(), random.Random(3)
    texts = [[rng.choice([b"the", b"of", b"rare", b"x", "né".encode(), b"longerword"]) for _ in range(n)] for n in (0, 1, 5, 40)]
    got, _ = m.run(texts, *m.symbols.numbers(texts))
    for g, t in zip(got, texts, strict=True):
        assert g == pytest.approx(by_bits(m, t), rel=2e-4)


def test_code_is_complete():
    """The probabilities of all continuations at a start sum to one, and so do those inside a word: Huffman codes without a gap."""
    size = mixer().code.size
    assert sum(2.0 ** -int(s) for s in size[: M.FIRST]) == 1.0
    assert sum(2.0 ** -int(s) for s in size[M.FIRST :]) == 1.0


def test_empty_and_untrained(spark):
    assert M.score_texts(table(spark, [])).count() == 0
    held = next(d for d in range(100) if zlib.crc32(str(d).encode()) % 5 == 1)
    r = M.score_texts(table(spark, [(held, "a b")])).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0)


def test_dictionary_and_counts_come_from_all_training_texts(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    docs = [(k, " ".join(rng.choices(words, k=6))) for k in range(5000)]
    frame = table(spark, docs).select("doc_id", "text")
    counts, tokens, different, (known, n, _) = M.fitted(frame, most_symbols=50, most_frequent=100)
    train = [t.split() for d, t in docs if zlib.crc32(str(d).encode()) % 5 != 1]
    c = Counter(w for t in train for w in t)
    order = sorted(c, key=lambda w: (-c[w], w))
    assert [w.decode() for w in known.words] == order[:50]
    assert (tokens, different) == (sum(c.values()) + len(train), len(c) + 1)
    assert {bytes(r["key"]).decode(): r["n"] for r in counts.collect()} == {**c, "\n": len(train)}
    assert dict(zip(known.counted, n)) == {**{w.encode(): c[w] for w in order[:99]}, M.END: len(train)}
    inside = Counter(b for t in train for w in t for b in w.encode()[1:] + b" ")
    assert {r["byte"]: r["n"] for r in M.byte_counts(counts.where("key != X'0A'")).collect() if r["n"]} == inside
    symbol = {w: M.WORDS + k for k, w in enumerate(order[:50])}
    line = lambda t: zip([0, *(M.tail(w.encode()) for w in t)], [*(symbol.get(w, M.FIRST + ord("w")) for w in t), M.FIRST + 10])
    pairs = Counter(before << 32 | s for t in train for before, s in line(t))
    found = M.pair_counts(frame.where(M.crc_mod(M.F.col("doc_id"), 5) != 1).select("text"), [w.encode() for w in order[:50]])
    assert {r["key"]: r["n"] for r in found.collect()} == pairs
