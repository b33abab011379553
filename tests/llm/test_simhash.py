import random

import numpy as np
import pytest
import xxhash

from peakforge.llm import simhash


def brute_print(text):
    """Shingle by shingle, bit by bit."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c == " " or "\t" <= c <= "\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints, budget=4):
    """Smallest index reachable by links, by comparing everything with everything."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    a = np.array(prints, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= budget) + i + 1:
            x, y = find(i), find(int(j))
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(a))]


def near(rng, base, flips):
    for b in rng.sample(range(64), flips):
        base ^= 1 << b
    return base


@pytest.mark.parametrize("m", [1, 2, 4])
def test_every_link_shares_a_key(m):
    rng = random.Random(m)
    sizes = {len(x) for x in simhash.tables(4, m)}
    assert sizes == {64}
    a = [rng.getrandbits(64) for _ in range(200)]
    b = [near(rng, x, 4) for x in a]
    hit = np.zeros(200, bool)
    from itertools import combinations

    picks = list(combinations(np.array_split(np.arange(64), 4 + m), m))
    for order, chosen in zip(simhash.tables(4, m), picks, strict=True):
        bits = sum(map(len, chosen))
        x, y = (simhash.permuted(np.array(v, np.uint64), order) for v in (a, b))
        hit |= (x >> np.uint64(64 - bits)) == (y >> np.uint64(64 - bits))
        assert (simhash.permuted(x, np.argsort(order)) == np.array(a, np.uint64)).all()
    assert hit.all()


@pytest.mark.parametrize("spread", [2, 3, 5, 9])
def test_subtrie_equals_brute_force(spread):
    rng = random.Random(spread)
    fps = {rng.getrandbits(64) for _ in range(100)}
    for _ in range(6):
        c = rng.getrandbits(64)
        fps |= {near(rng, c, rng.randint(0, spread)) for _ in range(120)}
    fps = np.array(sorted(fps), np.uint64)
    group = (fps >> np.uint64(63)).astype(int)
    a, b = simhash.subtrie_links(fps, 1, 4, group, chunk=50)
    assert (group[a] == group[b]).all()
    root = np.arange(len(fps))
    root[b] = a
    want = []
    for g in (0, 1):
        at = np.flatnonzero(group == g)
        want += [int(at[i]) for i in brute_components(fps[at].tolist())]
    assert root.tolist() == want


@pytest.mark.parametrize("limits", [{}, {"subtrie": 1}, {"max_subtrie": 20}])
def test_links_span_the_components(spark, limits):
    rng = random.Random(7)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(4):
        c = rng.getrandbits(64)
        fps |= {near(rng, c, rng.randint(0, 4)) for _ in range(60)}
    chain = rng.getrandbits(64)
    for k in range(30):  # linked only one after another
        fps.add(chain)
        chain = near(rng, chain, 3)
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    root = {r["node"]: r["root"] for r in simhash.components(simhash.links(nodes, **limits)).collect()}
    want = brute_components(fps)
    got = {}
    for i, s in enumerate(signed):
        got.setdefault(root.get(s, s), []).append(i)
    groups = {}
    for i, w in enumerate(want):
        groups.setdefault(w, []).append(i)
    assert sorted(got.values()) == sorted(groups.values())


def test_near_duplicates_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    extra = [(None, "a b c d e"), (900001, None), (900002, ""), (900003, " \n"), (900004, "A b C"), (900005, "a B c"), (900005, "a B c"), (900006, "wörd Ä " * 9000), (0, "another text under an id that is taken"), (None, "alone without an id")]
    rows = [tuple(r) for r in docs.collect()] + extra
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, fp int")
    got = sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=repr)
    prints = [brute_print(t) for _, t in rows]
    comp = brute_components(prints)
    low = {}
    for c, (d, _) in zip(comp, rows, strict=True):
        if d is not None:
            low[c] = min(d, low.get(c, d))
    want = sorted(((d, int(np.uint64(p).view(np.int64)), low.get(c)) for (d, _), p, c in zip(rows, prints, comp, strict=True)), key=repr)
    assert got == want
    kept = simhash.drop_near_duplicates(df, width=4)
    assert kept.count() == len(set(comp)) and kept.columns == df.columns
    assert simhash.near_duplicates(df.limit(0)).count() == 0
