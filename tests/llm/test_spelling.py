import random
import re
import zlib
from collections import Counter

import pytest

from peakforge.llm import spelling as S


def near(a, b):
    """Whether one inserted, deleted or replaced code point turns a into b, by trying every place."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(docs, one_in=199):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if k >= 5 and len(w) >= 6}
    forms, count = {}, {}
    for w in n:
        own = [v for v in n if near(v, w)]
        count[w] = len(own)
        top = min(own, key=lambda v: (-n[v], v), default=None)
        forms[w] = top if top is not None and n[top] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.add((w, forms[w], root, n[w], count[w], n[forms[w]] if forms[w] else None))
    return out


def texts(seed, rows, letters):
    """Words with misspellings at falling frequencies, so that forms stand in chains."""
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 13))) for _ in range(60)]
    for w in list(words):
        k = rng.randrange(len(w))
        words += [w[:k] + rng.choice(letters) + w[k + 1 :], w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:]]
    weights = [6.0 ** -rng.randrange(5) for _ in words]
    out = [(k // 2 if k % 7 else None, " ".join(w if rng.random() < 0.8 else w.capitalize() for w in rng.choices(words, weights, k=120))) for k in range(rows)]
    return [*out, (5, None), (6, ""), (7, "x" * 5000 + " " + "y1" * 3000), (8, "É" * 6 + " " + "é" * 6 + " ×÷×÷×÷ " * 6)]


def table(spark, docs):
    return spark.createDataFrame([(d, t, 1, "n") for d, t in docs], "doc_id long, text string, n long, word string")


@pytest.mark.parametrize("letters", ["ab", "eéàthron", "abcdefghijklmnopqrstuvwxyz"])
def test_equals_brute_force(spark, letters):
    """One alphabet of two letters, in which nearly every word is a permutation of another one."""
    docs = texts(len(letters), 300, letters)
    got = S.group_variants(table(spark, docs)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == brute(docs)


def test_near_words_share_a_signature():
    rng = random.Random(4)
    for _ in range(3000):
        w = "".join(rng.choice("abné") for _ in range(rng.randrange(6, 20)))
        k = rng.randrange(len(w))
        for v in (w[:k] + rng.choice("abnéz") + w[k + 1 :], w[:k] + w[k + 1 :], w[:k] + rng.choice("abz") + w[k:]):
            assert S.signatures(w) & S.signatures(v)


def test_counts_handed_on_early(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST_WORDS", 10)
    docs = texts(1, 100, "abcde")
    n = {r[0]: r[3] for r in brute(docs)}
    assert {r["word"]: r["n"] for r in S.counted(table(spark, docs)).collect()} == n


def test_empty_table(spark):
    assert S.group_variants(table(spark, [])).count() == 0
    assert S.group_variants(table(spark, [(1, None), (2, "a b c")])).count() == 0


def test_nothing_is_broadcast(spark, monkeypatch):
    """The words of a small corpus fit Spark's threshold; their signatures, a dozen each, are not small for it."""
    plans, keep = [], S.written

    def written(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, name)

    monkeypatch.setattr(S, "written", written)
    last = S.group_variants(table(spark, texts(3, 50, "abcde")))
    plans.append(last._jdf.queryExecution().executedPlan().toString())
    assert len(plans) >= 5 and any("SortMergeJoin" in p for p in plans)
    assert not [p for p in plans if "BroadcastHashJoin" in p or "BroadcastExchange" in p]
