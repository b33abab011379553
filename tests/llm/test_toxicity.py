import random

import numpy as np

from peakforge.llm import toxicity as tox
from peakforge.llm.langid import subwords


def test_gradients_agree_with_differences():
    net = tox.Net(buckets=64, width=3, hidden=4).start()
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    words = subwords(["ab", "ba", "abc", "c", "dd"], 64, tox.GRAMS)
    at = np.array([[0, 1, 2, -1], [3, 4, 0, 1], [2, 2, -1, -1]])
    y, weight = np.array([1, 0, 1]), np.array([2.0, 1.0, 1.0])

    def loss():
        rows = np.concatenate([net.project(net.inputs(*words).astype(np.float64)), net.pad_row()[None]])
        x, h = rows[at.T], 3 * net.hidden
        z = net.logits(x[:, :, :h], x[:, :, h:], at.T < 0)
        return float((weight * (np.logaddexp(0, z) - y * z)).mean())

    before = {k: v.copy() for k, v in net.p.items()}
    net.past = {k: np.ones_like(v) * 1e12 for k, v in net.p.items()}
    net.step(words, at, y, weight, 1.0)  # with huge past sums a step is the gradient / 1e6
    grad = {k: (before[k] - net.p[k]) * 1e6 for k in net.p}
    net.p = before
    rng = random.Random(1)
    for k in net.p:
        for _ in range(6):
            i = tuple(rng.randrange(n) for n in net.p[k].shape)
            old = net.p[k][i]
            net.p[k][i] = old + 1e-4
            up = loss()
            net.p[k][i] = old - 1e-4
            down = loss()
            net.p[k][i] = old
            assert abs((up - down) / 2e-4 - grad[k][i]) < 2e-3, (k, i)


def test_windows_cover_all_words():
    at, sizes = np.arange(1, 60), np.array([0, 3, 16, 40])
    w, n = tox.window_rows(at, sizes, 0)
    assert n.tolist() == [1, 1, 1, 3] and len(w) == 6
    assert (w[0] == 0).all() and w[1].tolist() == [1, 2, 3] + [0] * 13
    for a, b in ((1, 2), (2, 3), (3, 6)):
        assert set(w[a:b].ravel()) - {0} == set(at[(np.cumsum(sizes) - sizes)[a] : np.cumsum(sizes)[a]])


def test_padding_does_not_matter():
    net = tox.Net(buckets=64).start()
    reader = tox.Reader(net)
    one = reader.score(["a b c", None, "a b c " * 30, "x"])
    assert np.allclose(one[[0, 3]], [reader.score(["a b c"])[0], reader.score(["x"])[0]], atol=1e-6)
    assert one[1] == net.share


def test_learns_a_marked_word(spark):
    rng = random.Random(0)
    plain = ["the", "and", "lorem", "ipsum", "dolor", "sit", "amet", "erat"]
    rows, labels = [], []
    for i in range(500):
        ws = [rng.choice(plain) for _ in range(rng.randint(5, 80))]
        bad = i % 4 == 1
        if bad:
            ws[rng.randrange(len(ws))] = rng.choice(["vilest", "vilish", "vilor"])
        rows.append((i, " ".join(ws), "clash", 1.0))
        labels.append((i, 1, int(bad)))
    rows += [(1000, None, "", None), (1001, "", "", None), (None, "vilest", "", None), (3, rows[3][1], "", None), (1002, "the vilest " * 3000, "", None)]
    labels += [(2000, 1, 1), (None, 1, 1), (5, 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, predicted double")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = tox.rate(docs, lab).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 500 and r["held_out"]]
    right = np.mean([r["predicted"] == (r["doc_id"] % 4 == 1) for r in held])
    assert len(held) > 60 and right > 0.95
    by = {r["doc_id"]: r for r in got}
    assert by[1000]["score"] == by[1001]["score"] < 0.3 and by[1002]["predicted"] == 1
    assert tox.rate(docs.limit(0), lab).count() == 0
    assert {r["predicted"] for r in tox.rate(docs, lab.limit(0)).collect()} == {0}


def test_sample_is_bounded_whatever_repeats(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(400)] + [(k, "x" * (k * 10)) for k in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), *((k, k % 2) for k in range(2, 60))], "doc_id long, toxic int")
    got, total = tox.sample(docs, labels, 7, 12, 300)
    found = got.collect()
    assert sum(r["toxic"] for r in found) <= 7 and sum(1 - r["toxic"] for r in found) <= 12 and max(len(r["text"]) for r in found) <= 300
    assert total[1] > 7 and total[0] > 12


def test_query_equals_window_by_window_scores(spark):
    """The score of a whole text is the logistic function of its best window, each run through the network alone, in plain loops."""
    net = tox.Net(buckets=256, seed=3).start()
    net.scale = (-1.0, 0.7, 0.2)
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["ab", "cde", "fg,", "Hi", "zz9"]) for _ in range(n)) for n in (1, 5, 16, 17, 40, 90)]
    got = {r["doc_id"]: r["score"] for r in tox.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), net).collect()}
    for k, text in enumerate(texts):
        chunks, best, n = text.split(), -1e9, 0
        starts = [0, *range(tox.STEP, max(1, len(chunks) - tox.SPAN + tox.STEP), tox.STEP)]
        for s in starts:
            part = chunks[s : s + tox.SPAN]
            words = [tox.NOT_LETTERS.sub("", c.lower()) for c in part]
            at = np.array([[*range(len(words)), *[-1] * (tox.SPAN - len(words))]])
            proj = np.concatenate([net.project(net.inputs(*subwords(words, net.buckets, tox.GRAMS))), net.pad_row()[None]])
            x, h = proj[at.T], 3 * net.hidden
            best, n = max(best, float(net.logits(x[:, :, :h], x[:, :, h:], at.T < 0)[0])), n + 1
        want = tox.sigmoid(net.scale[0] + net.scale[1] * best + net.scale[2] * np.log(n))
        assert abs(got[k] - want) < 1e-4, (k, got[k], want)
