import hashlib
import random
import re

import pytest

from peakforge.llm import mixing


def fill(sizes, weights, budget, passes=2):
    """Targets by raising one common level until the budget is used up."""
    caps = [passes * s for s in sizes]
    if budget >= sum(caps):
        return [float(c) for c in caps]
    low, high = 0.0, max(c / w for c, w in zip(caps, weights, strict=True))
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(w * mid, c) for w, c in zip(weights, caps, strict=True)) < budget else (low, mid)
    return [min(w * low, c) for w, c in zip(weights, caps, strict=True)]


def place(d, t):
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    return md5(f"{'' if d is None else d} {md5(t or '')}")


def brute(rows, weights=(3, 1, 2), share=1.5, passes=2):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    totals = {n: sum(size(t) for _, t, s in rows if s == n) for n in names}
    w = {n: weights[k % len(weights)] for k, n in enumerate(names)}
    budget = min(share, passes) * sum(totals.values())
    line = []
    for k, n in enumerate(names):
        given = 0
        own = sorted((place(d, t), size(t)) for d, t, s in rows if s == n)
        for i, x in enumerate(own):
            given += x[1]
            for e in range(passes):
                if x[1]:
                    line.append(((given + e * totals[n]) / w[n], k, e, x[0], i, x[1], n))
    used, copies = 0, {}
    for *_, x, i, weight, n in sorted(line):
        used += weight
        if used > budget:
            break
        copies.setdefault((n, x), {}).setdefault(i, 0)
        copies[n, x][i] += 1
    targets = dict(zip(names, fill([totals[n] for n in names], [w[n] for n in names], budget, passes), strict=True))
    out, left = [], {key: sorted(c.values(), reverse=True) for key, c in copies.items()}
    for d, t, s in rows:
        own = left.get((s, place(d, t)), [])
        out.append((d, size(t), totals[s], round(targets[s], 3), (own.pop(0) if own else 0) * size(t)))
    return sorted(out, key=repr)


def texts(rng, n, sources):
    return [(i, " ".join("w" for _ in range(rng.randint(0, 60))), rng.choice(sources)) for i in range(n)]


@pytest.mark.parametrize("share", [0.4, 1.5, 2.0, 3.0])
def test_plan_equals_brute_force(spark, share):
    rng = random.Random(5)
    rows = texts(rng, 250, ["a"] * 8 + ["b", "c", "Ä", "d", None])
    rows += [(None, "x y", "a"), (None, None, None), (3, rows[3][1], rows[3][2]), (3, rows[3][1], rows[3][2]), (900, "", "zero"), (901, "w " * 9000, "long"), (902, None, "b")]
    docs = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, source string, size int, weight double").repartition(5)
    got = mixing.mix_plan(docs, share=share).collect()
    assert sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 3), r["taken"]) for r in got), key=repr) == brute(rows, share=share)
    mixed = mixing.mix(docs, share=share)
    assert mixed.columns == docs.columns
    words = sum(len(r["text"].split()) for r in mixed.collect())
    assert words == sum(r["taken"] for r in got)


@pytest.mark.parametrize("share", [0.3, 1.5])
def test_repeated_rows_meet_the_targets(spark, share, monkeypatch):
    """Of 100 texts of a source 60 are one row that repeats; they are taken one by one, over many slots and stretches of the plan."""
    monkeypatch.setattr(mixing, "STRETCH", 7)
    rows = [(k, "w " * 300, "a") for k in range(100)] + [(1000 + k, f"v{k} " * 100, "b") for k in range(40)] + [(2000, "x " * 100, "b")] * 60 + [(3000, "s", "b")] * 500
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, source string, row int").repartition(6)
    got = mixing.mix_plan(docs, share=share).collect()
    assert sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 3), r["taken"]) for r in got), key=repr) == brute(rows, share=share)
    for s in "ab":
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.01 * own[0]["target"] + 300
        assert all(r["taken"] <= 2 * r["size"] for r in own)
    mixed = mixing.mix(docs, share=share).collect()
    assert sum(len(r["text"].split()) for r in mixed) == sum(r["taken"] for r in got)
    per_row = {}
    for r in mixed:
        per_row[r["row"]] = per_row.get(r["row"], 0) + 1
    assert max(per_row.values()) <= 2


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_plan(docs).count() == 0 == mixing.mix(docs).count()
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], docs.schema)
    assert sorted(r["taken"] for r in mixing.mix_plan(blank).collect()) == [0, 0] and mixing.mix(blank).count() == 0


def test_names_that_the_plan_uses(spark):
    rows = [(k, "w " * (k % 7 + 1), "ab"[k % 2], 1, 2, 3, "s") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, plan_place int, plan_copies int, plan_source int, shuffle string")
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    taken = sum(r["taken"] for r in mixing.mix_plan(docs).collect())
    assert sum(len(r["text"].split()) for r in mixed.collect()) == taken and {r["plan_copies"] for r in mixed.collect()} == {2}


def test_repeated_ids_are_no_peers(spark):
    """Null and repeated ids with texts of their own are placed by the text, and taken one by one."""
    docs = spark.createDataFrame([(None, f"t{k} w w", "a") for k in range(300)], "doc_id long, text string, source string")
    got = mixing.mix_plan(docs, share=0.5).collect()
    assert len({r["shuffle"] for r in got}) == 300 and abs(sum(r["taken"] for r in got) - 450) <= 3
