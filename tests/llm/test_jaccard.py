import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from peakforge.llm import jaccard


def brute(rows, similarity=0.8):
    """Ids that stay, by comparing every document with every other."""
    sets = []
    for _, t in rows:
        w = (t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        n = len(sets[a] & sets[b])
        if sets[a] == sets[b] or n and n >= similarity * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    first = {}
    for i, (d, _) in enumerate(rows):
        first.setdefault(find(i), []).append(d)
    return sorted(min((d for d in ds if d is not None), default=-1) for ds in first.values())


def test_near_dedup_equals_brute_force_jaccard(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(30):  # edits up to and beyond the threshold, chains of edits, and copies
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([4, 12, 60, 300]))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 8)):
            changed = words[:]
            for _ in range(rng.randint(0, max(1, len(words) // 30))):
                changed[rng.randrange(len(words))] = "edit"
            texts.append(" ".join(changed))
            if rng.random() < 0.3:
                words = changed
    texts += [None, "", " ", "one two", "one two", "one two three"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    rows.append((None, texts[0]))
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, lang string")
    got = pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    kept, want = sorted(r["doc_id"] for r in got.collect()), brute(rows)
    assert set(want) <= set(kept)  # no link that is not there
    assert len(kept) - len(want) <= 0.02 * (len(rows) - len(want))  # and hardly one missed
    assert pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_near_dedup_of_the_sample_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"] and r["text"].encode().lower().decode()) for r in docs.select("doc_id", "text").collect()]
    kept, want = {r["doc_id"] for r in jaccard.drop_near_copies(docs).collect()}, set(brute(rows))
    assert want <= kept and len(kept - want) <= 0.02 * (len(rows) - len(want))


def test_recall_by_similarity():
    """Pairs of sets of known similarity among noise: the share that some subtrie links, by band of similarity."""
    rng, n = np.random.default_rng(5), 20_000
    above, budget, most, choices = jaccard.tables_for(n, 0.8)
    assert above >= 8
    for similarity, least in ((0.8, 0.95), (0.85, 0.98), (0.9, 0.99)):
        hit, pairs = 0, 400
        for _ in range(pairs):
            size = int(rng.integers(40, 400))
            shared = round(2 * similarity * size / (1 + similarity))
            words = rng.integers(0, 2**64, 2 * size - shared, np.uint64)
            prints = np.array([jaccard.wide_print(words[:size]), jaccard.wide_print(words[size - shared :])])
            bits = np.unpackbits(prints.astype(">u8").view(np.uint8).reshape(2, -1), axis=1)
            apart = bits[0] != bits[1]
            hit += any(not apart[c[:above]].any() and apart[c[:64]].sum() <= budget and apart.sum() <= most for c in choices)
        assert hit >= least * pairs, (similarity, hit / pairs)


def test_hot_subtries_are_dealt_in_parts(spark):
    rng = random.Random(1)
    base = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join([*base, f"x{rng.randrange(10**6)}"])) for k in range(300)] + [(1000 + k, f"only {k} of these words here") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("near_node", F.lit("clash"))
    assert jaccard.drop_near_copies(docs).columns == ["doc_id", "text", "near_node"]
    tagged = jaccard.sketched(docs.select("text"), 5, ["node", "p0", "p1"])
    nodes = tagged.select("node", "p0", "p1").distinct()
    parts = jaccard.buckets(nodes, 0.8, max_subtrie=40)
    member = jaccard.components(parts.select(F.col("lead").alias("a"), F.col("node").alias("b")).where("a <> b"))
    assert max(r["count"] for r in member.groupBy("root").count().collect()) >= 290


def edited_copies(n, seed):
    """One text in n copies with edits of their own, up to and beyond the similarity to the least edited one."""
    rng = random.Random(seed)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for k in range(n):
        own = words[:]
        for _ in range(rng.randrange(0, 11)):
            own[rng.randrange(200)] = f"x{rng.randrange(40)}" if rng.random() < 0.2 else f"y{rng.randrange(10**9)}"
        rows.append((k, " ".join(own)))
    return rows


def test_one_large_group_of_edited_copies(spark, monkeypatch):
    """Pairs that are compared grow with the group, not with its square, and what is kept is what brute force keeps."""
    made = []
    whole = jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, sets, similarity: made.append(pairs.count()) or whole(pairs, sets, similarity))
    counts = {}
    for n in (300, 600, 1200):
        made.clear()
        rows = edited_copies(n, 7)
        kept = sorted(r["doc_id"] for r in jaccard.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        counts[n] = list(made)
        if n == 300:
            want = brute(rows)
            assert set(want) <= set(kept) and len(kept) - len(want) <= 0.02 * (n - len(want))
    assert sum(counts[600]) < 0.1 * 600 * 599 / 2 and sum(counts[1200]) <= 3 * sum(counts[600]), counts
    print("pairs compared by size of the group", counts)
