import random
import re
import time

import pytest

from peakforge.llm import decontaminate as dec


def norm(s):
    return re.sub(r"[\W_]+", " ", s.lower()).strip()


def best_edits(item, text):
    """Sellers' algorithm: edits of the best occurrence of item anywhere in text."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item):
            new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def damage(rng, s, edits):
    s = list(s)
    for _ in range(edits):
        i, kind = rng.randrange(len(s)), rng.randrange(3)
        if kind == 0:
            s[i] = rng.choice("abcxyz")
        elif kind == 1:
            del s[i]
        else:
            s.insert(i, rng.choice("abcxyz"))
    return "".join(s)


def words(rng, n):
    return " ".join("".join(rng.choice(["the", "an", "or", "ti", "es", "ing"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.mark.parametrize("seed", range(2))
def test_search_equals_brute_force(seed):
    rng = random.Random(seed)
    items = [(k, words(rng, rng.randint(9, 40)).capitalize() + ".") for k in range(8)]
    index = dec.Index.build(items, 9, 0.09, 30)
    texts = []
    for _ in range(14):
        parts = [words(rng, rng.randint(0, 30))]
        for _ in range(rng.randint(0, 2)):
            parts += [damage(rng, rng.choice(items)[1], rng.randint(0, 24)), words(rng, rng.randint(0, 30))]
        texts.append(rng.choice(["", "\n", "… "]).join(parts))
    texts += [None, "", items[0][1], items[0][1].upper(), "x" * 500, items[1][1] * 3]
    got = {(t, k): e for t, k, _, _, e in sorted(dec.search(texts, index), key=lambda x: -x[4])}
    want = {}
    for t, text in enumerate(texts):
        for k, item in zip(index.ids, index.items, strict=True):
            if len(item) < 30:
                continue
            b = best_edits("".join(map(chr, item)), norm(text or ""))
            if b <= index.budgets[index.ids.index(k)]:
                want[t, k] = b
    assert got == want


def test_hashes_are_those_of_grams():
    c, _ = dec.letters("abcabcabcabcabcabc")
    for q in (1, 2, 3, 7, 9, 12):
        h = dec.hashes(c, q)
        assert len(h) == len(c) - q + 1 and (h[:-3] == h[3:]).all() and len(set(h.tolist())) == 3


def test_spans_and_rows(spark):
    item = "The quick brown fox jumps over the lazy dog, twice or more."
    b = spark.createDataFrame([(7, item, 1), (8, None, 1), (9, "short", 1), (10, "A short one, though", 1), (11, " ?", 1)], "item_id long, text string, doc_id int")
    text = "É🙂 intro — " + item.replace(",", " ;") + " tail. " + item
    rows = [(1, text, "x"), (1, text, "x"), (None, item.upper(), None), (2, None, "y"), (3, "", "y"), (4, "lazy dog " * 20000, "z"), (5, "is a Short, one -- though!", "z"), (6, "shorts; a shorter one, through", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    got = [tuple(r) for r in dec.contaminated(docs, b).collect()]
    assert sorted((r[0] or 0, r[1], r[4]) for r in got) == [(0, 7, 0)] + [(1, 7, 0)] * 4 + [(5, 9, 0), (5, 10, 0)]
    assert {text[r[2] : r[3]] for r in got if r[0] == 1} == {item.replace(",", " ;")[:-1], item[:-1]}
    kept = dec.drop_contaminated(docs, b)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 6]
    assert dec.contaminated(docs.limit(0), b).count() == 0 == dec.contaminated(docs, b.limit(0)).count()
    assert dec.contaminated(docs, b, block_chars=1).count() == len(got)
    assert sorted(map(repr, dec.drop_contaminated(docs, b, block_chars=1).collect())) == sorted(map(repr, kept.collect()))


def test_shared_preamble():
    """Thousands of items with one preamble, and texts that repeat it: the same rows as brute force, in bounded time and pieces."""
    rng = random.Random(4)
    head = "Answer the following multiple choice question by the letter of the right option and nothing else: "
    items = [(k, head + words(rng, 9)) for k in range(2000)]
    index = dec.Index.build(items, 9, 0.09, 30)
    texts = [(head + " ") * 400, (head + words(rng, 6) + ". ") * 30 + items[7][1] + head, damage(rng, items[11][1], 5)]
    began = time.time()
    got = {(t, k): e for t, k, _, _, e in dec.search(texts, index)}
    assert time.time() - began < 60
    near = {(t, k) for t, k in got}
    assert (1, 7) in near and (2, 11) in near and not any(t == 0 for t, _ in near)
    for t, k in [*near, *((rng.randrange(1, 3), rng.randrange(2000)) for _ in range(6))]:
        item = index.items[k]
        if t:
            b = best_edits("".join(map(chr, item)), norm(texts[t]))
            assert ((t, k) in got) == (b <= index.budgets[k]) and got.get((t, k), b) == b


def test_pieces_find_the_same(monkeypatch):
    rng = random.Random(9)
    items = [(k, words(rng, rng.randint(2, 30))) for k in range(30)]
    texts = [" ".join([words(rng, 20), damage(rng, rng.choice(items)[1], rng.randint(0, 6)), words(rng, 20)]) for _ in range(40)]
    whole = sorted(dec.search(texts, dec.Index.build(items, 9, 0.09, 30)))
    monkeypatch.setattr(dec, "MOST_HITS", 3)
    monkeypatch.setattr(dec, "MOST_CELLS", 1000)
    assert whole and sorted(dec.search(texts, dec.Index.build(items, 9, 0.09, 30))) == whole


def test_short_items_are_whole_words():
    items = [(1, "Tiny"), (2, "two words"), (3, "this one is a bit longer")]
    index = dec.Index.build(items, 9, 0.09, 30)
    texts = ["a TINY, thing", "tinytiny", "Two -- words", "two wordsmiths", "so this one is a bit longer.", "so this one is a bit longe", None, ""]
    assert sorted((t, k, e) for t, k, _, _, e in dec.search(texts, index)) == [(0, 1, 0), (2, 2, 0), (4, 3, 0)]
