"""Near copies among documents: candidates by the SimHash trie self-join, links by exact Jaccard similarity of shingles.

Texts with the same set of word shingles are one node. A node's fingerprint is a SimHash of ``BITS`` bits of that set. The
trie self-join runs over ``tables_for`` choices of 64 of these bits: the first bits of a choice, about as many as halve the nodes down to 32,
lead to a subtrie, in which pairs of nodes are traversed together within a budget of differing bits; leaves that meet are held against a budget of all bits. Sets of
Jaccard similarity s differ in each bit with a chance of acos(2s / (1 + s)) / pi, so the number of choices follows
from ``MISS``, the share of pairs at the wanted similarity that no choice may find; pairs above it are missed less. What
a subtrie links is only a candidate: it is compared on the whole sets of shingles, and only pairs that reach the similarity
are linked.

A bucket, the nodes that one subtrie links, is settled in two rounds. First all its nodes are compared with its most central one. Where
that leaves more than one component, the nodes outside the bucket's largest component go through an exact set-similarity join with all nodes of such
buckets: shingles stand from the rarest to the most frequent, and two sets that reach the similarity share one of their first
n - ceil(similarity * n) + 1, within bounds of length and position. A copy too far from the most central one has that many
shingles of its own, which no other copy shares, so a group of near copies costs its size and not its square; what two such copies share by an edit in
common is found. Buckets of the same nodes, from several choices, are settled once.

Defined cases: null texts and texts without words are one group; shorter texts are one shingle; null ids come last; repeated
ids and rows count as documents; an empty table gives no rows; other columns are kept, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from peakforge.llm.common import free_name, order_key, written
from peakforge.llm.simhash import BYTE_BITS, components, in_subtries, shingle_hashes, subtrie_links

BITS, MISS = 128, 0.01


def shingles(text: str | None, width: int) -> np.ndarray:
    """The set of a text's shingle hashes, ordered."""
    return np.unique(shingle_hashes(text, width))


def mixed(x: np.ndarray) -> np.ndarray:
    """64 further bits of each hash."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def wide_print(found: np.ndarray) -> np.ndarray:
    """SimHash of a set of shingle hashes: BITS / 64 unsigned numbers, each bit the majority of that bit of the hashes."""
    out, h = [], found
    for _ in range(BITS // 64):
        per_byte = h.astype("<u8").view(np.uint8).reshape(-1, 8)
        ones = np.concatenate([np.bincount(per_byte[:, k], minlength=256) @ BYTE_BITS for k in range(8)])
        out.append(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])
        h = mixed(h)
    return np.array(out, np.uint64)


def tables_for(n: int, similarity: float) -> tuple[int, int, int, list[np.ndarray]]:
    """(bits above a subtrie, budget below it, budget of all bits, the bits of each choice: 64 of the trie and the rest) for ``n`` nodes."""
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
    above = min(40, max(0, math.ceil(math.log2(max(n, 1))) - 5))
    below = 64 - above
    budget = round(below * differ + 2.2 * math.sqrt(below * differ * (1 - differ)))
    hit = (1 - differ) ** above * 0.97  # of the pairs whose leading bits agree 3 in 100 exceed the budget
    count = max(4, math.ceil(math.log(MISS) / math.log(1 - hit)))
    rng = np.random.default_rng(42)
    most = round(BITS * differ + 3.5 * math.sqrt(BITS * differ * (1 - differ)))
    return above, budget, most, [rng.permutation(BITS) for _ in range(count)]


def sketched(docs: DataFrame, width: int, names: list[str]) -> DataFrame:
    """``docs`` with a hash of each text's set of shingles and the numbers of its SimHash, under ``names``."""
    schema = docs.select(*docs.columns, *(F.lit(0).cast("long").alias(c) for c in names)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.zeros((b.num_rows, len(names)), np.uint64)
            for k, t in enumerate(b.column("text")):
                found = shingles(t.as_py(), width)
                made[k, 0], made[k, 1:] = xxhash.xxh3_64_intdigest(found.tobytes()), wide_print(found)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c) for c in made.T.copy().view(np.int64))], [*b.schema.names, *names])

    return docs.mapInArrow(run, schema)


def buckets(nodes: DataFrame, similarity: float, max_subtrie: int = 200_000) -> DataFrame:
    """(key, node, lead): the nodes that a subtrie links, each set of them once.

    The lead is the node nearest to the majority of all bits: of copies with edits of their own, the least edited one, to which most of the
    others are similar enough.
    """
    above, budget, most, choices = tables_for(nodes.count(), similarity)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.column_stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(1, b.num_columns)])
            bits = np.unpackbits(np.ascontiguousarray(prints.astype(">i8")).view(np.uint8).reshape(len(prints), -1), axis=1)
            for t, chosen in enumerate(choices):
                p, rest = np.packbits(np.take(bits, chosen, axis=1), axis=1).view(">u8").astype(np.uint64).T.copy()
                root = (p >> np.uint64(64 - above)).astype(np.int64) if above else np.zeros(len(p), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), t, np.int32)), pa.array(root), pa.array(p.view(np.int64)), pa.array(rest.view(np.int64)), b.column(0)], ["t", "root", "p", "rest", "node"])

    def solve(x: pd.DataFrame) -> Iterator[pd.DataFrame]:
        change = (x[["t", "subtrie"]].to_numpy()[1:] != x[["t", "subtrie"]].to_numpy()[:-1]).any(1)
        group = np.cumsum(np.append(0, change))
        p, rest = (x[c].to_numpy().view(np.uint64) for c in ("p", "rest"))
        a, b = subtrie_links(p, above, budget, group, more=rest, most=most)
        node = x["node"].to_numpy()
        at = np.concatenate([np.unique(a), b])
        of = np.concatenate([np.unique(a), a])  # every member with its component
        order = np.argsort(of, kind="stable")
        at, of = at[order], of[order]
        if not len(at):
            return
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        size = np.diff(np.append(first, len(at)))
        comp = np.repeat(np.arange(len(first)), size)
        prints = np.column_stack([p[at], rest[at]])
        bits = np.unpackbits(np.ascontiguousarray(prints.astype(">u8")).view(np.uint8).reshape(len(at), -1), axis=1)
        middle = np.packbits(2 * np.add.reduceat(bits, first, axis=0, dtype=np.int64) > size[:, None], axis=1).view(">u8").astype(np.uint64)
        far = np.bitwise_count(prints ^ middle[comp]).sum(1)
        best = np.lexsort((node[at], far, comp))[first]
        with np.errstate(over="ignore"):
            key_ = np.add.reduceat(mixed(node[at].view(np.uint64)), first)
        yield pd.DataFrame({"key": key_[comp].view(np.int64), "node": node[at], "lead": node[at][best][comp]})

    keyed = nodes.mapInArrow(key, "t int, root long, p long, rest long, node long")
    return in_subtries(keyed, solve, "key long, node long, lead long", max_subtrie).distinct()


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """(node, words) for (node, text): the set of shingles of each node once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            nodes, sets = [], []
            for n, t in zip(b.column("node").to_pylist(), b.column("text"), strict=True):
                if n not in seen:
                    seen.add(n)
                    nodes.append(n)
                    sets.append(shingles(t.as_py(), width).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "words"])

    return texts.mapInArrow(run, "node long, words array<long>").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets of shingles reach the similarity."""
    few, many = F.least("na", "nb"), F.greatest("na", "nb")
    sizes = sets.select("node", F.size("words").alias("n"))
    likely = pairs.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b").where(few >= similarity * many).select("a", "b")
    both = likely.join(sets.toDF("a", "wa"), "a").join(sets.toDF("b", "wb"), "b")
    shared = F.size(F.array_intersect("wa", "wb"))
    return both.where(shared >= similarity * (F.size("wa") + F.size("wb") - shared)).select("a", "b")


def links(tagged: DataFrame, *, width: int, similarity: float) -> DataFrame:
    """(node, root) of every node of ``tagged`` (node, text, prints...) that is linked to another one; root names the component."""
    prints = [c for c in tagged.columns if c not in ("node", "text")]
    nodes = written(tagged.groupBy("node").agg(*(F.first(c).alias(c) for c in prints)), "near-nodes")
    bucket = written(buckets(nodes, similarity), "near-buckets")
    of = written(bucket.select("node").distinct(), "near-candidates")  # of known size: texts need no shuffle while it is small
    sets = written(shingle_sets(tagged.select("node", "text").join(of, "node", "left_semi"), width), "near-sets")
    first = bucket.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    edges = written(verified(first, sets, similarity), "near-links-1")
    member = components(edges)
    rooted = bucket.join(member, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    sizes = rooted.groupBy("key", "root").count().groupBy("key").agg(F.max_by("root", "count").alias("main"), F.count("*").alias("n")).where("n > 1")
    open_ = rooted.join(sizes.select("key", "main"), "key").groupBy("node", "root").agg(F.bool_or(F.col("root") != F.col("main")).alias("stray"))
    more = written(verified(prefix_pairs(written(open_, "near-open"), sets, similarity), sets, similarity), "near-links-2")
    return member if more.isEmpty() else components(edges.union(more))


def prefix_pairs(open_: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): all pairs of a stray and a node of another root, of ``open_`` (node, root, stray), whose sets may reach the similarity.

    Rare shingles first; the first shingle that two sets share stands at places after which both have room for the rest of what they have to share.
    That bounds the size of the partner from above for each place, so shingles are joined together with a class of sizes.
    """
    share = similarity / (1 + similarity)  # of both sizes together
    size_class = lambda n: F.floor(F.ln(n) / math.log(1.02)).cast("int")
    words = open_.join(sets, "node").select("node", "root", "stray", F.size("words").alias("n"), F.explode("words").alias("word"))
    often = words.groupBy("word").agg(F.count("*").alias("often")).where("often > 1")
    line = F.sort_array(F.collect_list(F.struct(F.coalesce("often", F.lit(1)).alias("often"), "word")))  # the shingles of one text
    ordered = words.join(often, "word", "left").groupBy("node", "root", "stray", "n").agg(line.alias("line"))
    long_ = (F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1).cast("int")
    prefix = ordered.select("node", "root", "stray", "n", F.posexplode(F.slice("line", 1, long_)).alias("at", "w")).where("w.often > 1").select("node", "root", "stray", "n", "at", "w.word")
    prefix = written(prefix.withColumn("most", (F.col("n") - F.col("at")) / share - F.col("n") + 1e-6), "near-prefixes")  # the largest partner whose first shared shingle this can be
    least = F.col("n") * similarity - 1e-6
    a = prefix.where(F.col("stray") & (F.col("most") >= least)).withColumn("class", F.explode(F.sequence(size_class(least), size_class(F.least(F.col("most"), F.col("n") / similarity + 1e-6)))))
    a = a.select("word", "class", *(F.col(c).alias(f"{c}_a") for c in ("node", "root", "n", "most")))
    b = prefix.select("word", size_class(F.col("n")).alias("class"), *(F.col(c).alias(f"{c}_b") for c in ("node", "root", "n", "most")))
    may = (F.col("root_a") != F.col("root_b")) & (F.col("n_b") <= F.col("most_a")) & (F.col("n_a") <= F.col("most_b"))
    return a.join(b, ["word", "class"]).where(may).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def drop_near_copies(docs: DataFrame, *, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` without all but one document of each group that links of at least ``similarity`` connect.

    The document with the smallest id stays (a null id comes last); of rows with that id and set of shingles, the one
    whose other columns are smallest.
    """
    node, *prints = names = [free_name(docs, c) for c in ("near_node", *(f"near_print{k}" for k in range(BITS // 64)))]
    rank = free_name(docs, "near_rank")
    tagged = written(sketched(docs, width, names), "near-tagged")
    member = links(tagged.select(F.col(node).alias("node"), F.col("text").cast("string").alias("text"), *(F.col(c).alias(f"p{k}") for k, c in enumerate(prints))), width=width, similarity=similarity)
    nodes = tagged.groupBy(F.col(node).alias("node")).agg(F.min(F.col("doc_id").cast("long")).alias("first_id"))
    found = written(nodes.join(member, "node", "left").withColumn("root", F.coalesce("root", "node")), "near-components")
    first = F.min(F.struct(F.col("first_id").isNull().alias("last"), "first_id", "node")).alias("k")
    keep = written(found.groupBy("root").agg(first).select(F.col("k.first_id").alias("keep_id"), F.col("k.node").alias("keep_node")), "near-keep").alias("k")
    kept = tagged.drop(*prints).alias("d").join(keep, (F.col(f"d.{node}") == F.col("k.keep_node")) & F.col("d.doc_id").eqNullSafe(F.col("k.keep_id")), "left_semi")
    w = W.partitionBy(node, "doc_id").orderBy(*(order_key(f) for f in docs.schema if f.name != "doc_id"))
    return kept.withColumn(rank, F.row_number().over(w)).where(F.col(rank) == 1).select(*docs.columns)
