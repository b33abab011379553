"""Spelling variants of the words of a corpus, grouped by PartEnum signatures of letter multisets.

A word's letters are a set of elements (letter, how many of it came before). Words that differ by one inserted or deleted letter differ in one
element, by one replaced letter in two. Elements are dealt to ``PARTS`` parts by a hash; two differences touch at most two parts, so two near words
agree on all elements of some ``PARTS - 2`` parts: these enumerated choices of parts are the signatures. Letters of a small
alphabet give many words one multiset (its permutations), so a signature also names the half of the word that the edit leaves alone: of two near
words whose shorter one has L letters, the first or the last floor(L / 2) letters are equal. Words are equi-joined on a hash of these signatures, and
what meets is verified by its edit distance. No join is left to a guess of sizes: all of them merge.

Words are counted per task and merged by one grouping; signatures are made for the words kept, not for texts. A word's form is its most frequent near word if that
is ``ratio`` times as frequent; forms are followed to their last by doubling the steps, so the rounds grow with the logarithm of the longest chain.

Defined cases: null and empty texts have no words; a null id is the empty text in the hash; repeated rows and ids count as rows; ties of frequency go to the smaller word in
code-point order; very long runs are words like others; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakforge.llm.common import written

RUN = re.compile("[a-zÀ-ÿ]+")
PARTS = 4
CHOICES = list(combinations(range(PARTS), PARTS - 2))
#: A task hands its counts on when it holds so many different words or characters of them.
MOST_WORDS, MOST_CHARS = 400_000, 32_000_000


def damaged(doc_id: int | None, run: str, one_in: int) -> str:
    """``run`` as it is, or without one code point if a hash of id and run says so."""
    h = zlib.crc32(run.encode(), zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()))
    if h % one_in:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def counted(docs: DataFrame, *, one_in: int = 199, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """(word, n) of all words of at least ``least_length`` code points that occur ``least_count`` times in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        chars = 0

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = Counter(RUN.findall((text.as_py() or "").encode().lower().decode()))
                for w, n in own.items():
                    w = damaged(doc_id, w, one_in)
                    if len(w) >= least_length:
                        if w not in held:
                            chars += len(w)
                        held[w] += n
                if len(held) > MOST_WORDS or chars > MOST_CHARS:
                    yield told()
                    held.clear()
                    chars = 0
        yield told()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def signatures(word: str) -> set[int]:
    """Hashes of the signatures of a word; near words share at least one."""
    seen: Counter[str] = Counter()
    parts: list[list[str]] = [[] for _ in range(PARTS)]
    for c in word:
        element = f"{c}{seen[c]}"
        seen[c] += 1
        parts[zlib.crc32(element.encode()) % PARTS].append(element)
    told = ["".join(sorted(p)) for p in parts]
    out = set()
    for m in {len(word) // 2, (len(word) - 1) // 2}:
        for side, half in enumerate((word[:m], word[len(word) - m :])):
            for k, choice in enumerate(CHOICES):
                out.add(xxhash.xxh3_64_intdigest("\n".join((f"{k} {side} {half}", *(told[p] for p in choice)))) - (1 << 63))
    return out


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, na, b, nb), a < b: all pairs of (word, n) that one edit turns into one another, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                made = [signatures(w) for w in part.column(0).to_pylist()]
                own = pa.array([k for k, m in enumerate(made) for _ in m], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([s for m in made for s in m], pa.int64()), part.column(0).take(own), part.column(1).take(own)], ["signature", "word", "n"])

    keyed = words.select("word", "n").mapInArrow(run, "signature long, word string, n long")
    # a word has a dozen signatures: Catalyst takes them for as small as the written words, and would send them through the driver
    both = keyed.toDF("signature", "a", "na").join(keyed.toDF("signature", "b", "nb").hint("merge"), "signature").where("a < b")
    return both.where(F.levenshtein("a", "b", 1) == 1).select("a", "na", "b", "nb").distinct()


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the last word that following forms leads to; steps double in each round."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        after = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = written(now.join(after.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        now = stepped.select("word", "root")
        if stepped.where("moved").isEmpty():
            return now


def group_variants(docs: DataFrame, *, ratio: int = 5, **options: int) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``docs``; ``options`` go to ``counted``."""
    words = written(counted(docs, **options), "spelling-words")
    pairs = written(near_pairs(words), "spelling-pairs")
    ways = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("m")))).alias("w")).select("w.*")
    best = F.min(F.struct((-F.col("m")).alias("minus"), F.col("near")))
    told = words.join(ways.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best")).hint("merge"), "word", "left")
    fits = -F.col("best.minus") >= ratio * F.col("n")
    told = told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.minus")).alias("form_n"))
    told = written(told, "spelling-forms")
    roots = last_forms(told.where("form IS NOT NULL"))
    return told.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
