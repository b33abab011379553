import random

import numpy as np
from pyspark.sql import functions as F

from peakforge.llm import langid

WORDS = {"aa": ["lorem", "ipsum", "dolor", "amet"], "bb": ["zwisch", "über", "größe", "mich"], "cc": ["œuvre", "été", "où", "très"]}


def rows(n, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        out.append((i, " ".join("".join(rng.choices(WORDS[lang], k=rng.randint(1, 2))) for _ in range(rng.randint(2, 60))), lang))
    return out


def brute_rows(word, buckets, longest):
    """The same hashes, one gram at a time."""
    m, p = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def row(h):
        h = ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) & m
        return (h >> 32) % buckets

    w, grams = f"<{word}>", []
    for i in range(len(w)):
        h = 0
        for n in range(1, longest + 1):
            if i + n <= len(w):
                h = (h * p + ord(w[i + n - 1]) + n) & m
                grams.append(row(h))
    return grams, row(sum(ord(c) * pow(p, k + 1, 1 << 64) for k, c in enumerate(w)) & m)


def test_hashed_rows():
    words = ["a", "été", "", "langue🙂", "zz"]
    grams, counts, whole = langid.subwords(words, 997, 4)
    want = [brute_rows(w, 997, 4) for w in words]
    assert counts.tolist() == [len(g) for g, _ in want] and whole.tolist() == [h for _, h in want]
    assert grams.tolist() == [x for g, _ in want for x in g]
    assert langid.subwords([], 997)[0].size == 0


def test_sums_do_not_depend_on_what_was_seen():
    data = rows(60)
    model = langid.train([t for _, t, _ in data], [x for *_, x in data], [i % 5 == 1 for i, *_ in data], buckets=4096)
    texts = [t for _, t, _ in rows(40, 1)] + ["", None, "12 34", "x-y_z É"]
    once = langid.Scorer(model).totals(texts)
    small = langid.Scorer(model, max_chunks=5)
    assert np.allclose(once, np.concatenate([small.totals([t], 1) for t in texts]))
    assert (once[-4:-1] == 0).all() and once[-1, -1] > 0


def test_predictions(spark):
    data = rows(900) + [(5000, None, "aa"), (5001, "", "bb"), (5002, "1234 -- !!", "cc"), (None, "lorem ipsum", None), (7, "lorem", "aa"), (5003, "été où " * 20000, None)]
    docs = spark.createDataFrame([(*r, "x", 0.5) for r in data], "doc_id long, text string, lang string, source string, score double")
    got = langid.identify(docs, buckets=4096).collect()
    assert len(got) == len(data)
    truth = {i: x for i, _, x in data}
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 900]
    assert len(held) > 100 and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.98
    assert not any(r["rejected"] for r in held if r["lang_pred"] == truth[r["doc_id"]] and r["score"] >= 0.5)
    by = {r["doc_id"]: r for r in got}
    for i in (5000, 5001, 5002):
        assert by[i]["lang_pred"] == "und" and by[i]["score"] == 0 and by[i]["rejected"]
    assert by[5003]["lang_pred"] == "cc"
    assert langid.identify(docs.limit(0)).count() == 0
    none = langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}


def test_sample_is_bounded_whatever_repeats(spark):
    one = [(34, f"lorem ipsum {k}", "aa") for k in range(500)] + [(34, "dolor " * 400, "bb")] * 300
    docs = spark.createDataFrame(one, "doc_id long, text string, lang string")
    got = langid.sample(docs, 10, 50).collect()
    assert sum(r["lang"] == "aa" for r in got) == 10 and sum(r["lang"] == "bb" for r in got) <= 10
    assert max(len(r["text"]) for r in got) <= 50


def test_names_that_the_model_uses(spark):
    data = rows(60)
    model = langid.train([t for _, t, _ in data], [x for *_, x in data], [i % 5 == 1 for i, *_ in data], buckets=4096)
    docs = spark.createDataFrame([(1, "lorem ipsum", 5, 6), (2, "12", 5, 6)], "doc_id long, text string, rejected int, score int")
    assert langid.predict(docs, model).columns == [*docs.columns, "lang_pred", "score_", "rejected_"]
    kept = langid.confident(docs, model).collect()
    assert [tuple(r) for r in kept] == [(1, "lorem ipsum", 5, 6)]


def test_query_equals_word_by_word_sums(spark):
    """The prediction of a whole text is that of the sums over its words, each scored alone."""
    data = rows(200)
    model = langid.train([t for _, t, _ in data], [x for *_, x in data], [i % 5 == 1 for i, *_ in data], buckets=4096)
    texts = [t for _, t, _ in rows(30, 7)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    for k, text in enumerate(texts):
        sums, n = np.zeros(len(model.langs)), 0
        for word in langid.letter_runs(text):
            grams, whole = brute_rows(word, 4096, 4)
            sums += sum(model.table[g] for g in grams) + model.table[whole]
            n += len(grams) + 1
        z = (sums / n + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[k]["lang_pred"] == model.langs[int(p.argmax())] and abs(got[k]["score"] - p.max()) < 1e-6


def test_numerals_are_no_letters(spark):
    assert all(bool(langid.letter_runs(c)) == c.isalpha() for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000)
    assert langid.letter_runs("Ab½cd 12x² _É") == ["ab", "cd", "x", "é"]
    data = rows(60)
    model = langid.train([t for _, t, _ in data], [x for *_, x in data], [i % 5 == 1 for i, *_ in data], buckets=4096)
    docs = spark.createDataFrame([(1, "² ½"), (2, "Ⅷ ① 12"), (3, "½ lorem ipsum")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"] == "und", r["score"]) for r in langid.predict(docs, model).collect()}
    assert got[1] == got[2] == (True, 0.0) and not got[3][0]
