"""SimHash near-duplicates by a binary trie self-join.

Fingerprints within ``max_bits`` of each other agree on at least one of ``max_bits + m`` blocks of bits taken ``m`` at
a time, so for each choice of m blocks the fingerprints are keyed by those bits: each key is the root of a subtrie in
which the chosen bits lie above the root and differ nowhere. A task takes a sorted run of such subtries and traverses
pairs of nodes together, level by level: the differing bits of a pair add up, a pair over the budget is dropped, and
a pair whose nodes already lie in one component, or can no longer exceed the budget, is settled as a whole. It
returns a spanning forest of each subtrie, never all pairs; components of the forests are joined in Spark.

``m`` is the smallest number for which a key is expected to hold no more than ``subtrie`` fingerprints, so it grows
with the logarithm of the input; all choices find the same links. A key with more than ``max_subtrie`` fingerprints
is dealt out as pairs of parts.

Defined cases: a null text and a text without words have fingerprint 0, which links like any other; null ids get the
component of their text, whose smallest id ignores nulls (null if all are); repeated ids and rows are kept; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from peakforge.llm.common import free_name, order_key, written

BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(text: str | None, width: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of each of a text's word shingles, in order; of all its words where there are fewer than ``width``."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, only ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """SimHash of a whole text as an unsigned 64-bit number: majority of the bits of its shingles' XXH64."""
    hashes = shingle_hashes(text, width, seed)
    if not len(hashes):
        return 0
    per_byte = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(per_byte[:, k], minlength=256) @ BYTE_BITS for k in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, width: int = 4, seed: int = 42, name: str = "fp") -> DataFrame:
    """``docs`` with the 64 bits of each text's fingerprint as a signed long, in a further column ``name``."""
    schema = docs.select(*docs.columns, F.lit(0).cast("long").alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width, seed) for t in b.column("text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps.view(np.int64))], [*b.schema.names, name])

    return docs.mapInArrow(run, schema)


def tables(max_bits: int, m: int) -> list[np.ndarray]:
    """For each choice of ``m`` of max_bits + m blocks, the order of bits (from the top) that puts those first."""
    blocks = np.array_split(np.arange(64), max_bits + m)
    orders = []
    for chosen in combinations(range(len(blocks)), m):
        rest = [b for k, b in enumerate(blocks) if k not in chosen]
        orders.append(np.concatenate([blocks[k] for k in chosen] + rest))
    return orders


def permuted(fps: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The fingerprints with bit ``order[k]`` (0 is the top one) moved to place k: runs of bits move together."""
    out = np.zeros_like(fps)
    at = 0
    while at < 64:
        n = 1
        while at + n < 64 and order[at + n] == order[at] + n:
            n += 1
        mask = np.uint64((1 << n) - 1)
        out |= ((fps >> np.uint64(64 - int(order[at]) - n)) & mask) << np.uint64(64 - at - n)
        at += n
    return out


class Forest:
    """Components of positions 0..n-1, merged by arrays of edges."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def merge(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.label[a], self.label[b]
            differ = x != y
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            if not len(a):
                break
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up

    def same_until(self) -> np.ndarray:
        """For each position, the first later one of another component."""
        n = len(self.label)
        ends = np.append(np.flatnonzero(self.label[1:] != self.label[:-1]) + 1, n)
        return ends[np.searchsorted(ends, np.arange(n), side="right")]


def subtrie_links(
    fps: np.ndarray, depth: int, budget: int, group: np.ndarray, chunk: int = 1 << 16, more: np.ndarray | None = None, most: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges (positions a, b) among the sorted distinct fingerprints of some subtries with roots at ``depth``.

    ``group`` numbers the subtrie of each position, in order. A node is a range [lo, hi) of positions that agree
    above its level; a pair of nodes at one level carries the bits that differ above it. ``more`` has further bits of each
    fingerprint: leaves that are compared may then differ in ``most`` bits in all.
    """
    n = len(fps)
    forest = Forest(n)

    def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        differ = np.bitwise_count(fps[a] ^ fps[b])
        return differ <= budget if more is None else (differ <= budget) & (differ + np.bitwise_count(more[a] ^ more[b]) <= most)

    every = np.arange(n)
    near = np.flatnonzero((group[1:] == group[:-1]) & close(every[1:], every[:-1]))
    forest.merge(near, near + 1)
    lo = np.append(0, np.flatnonzero(group[1:] != group[:-1]) + 1)
    hi = np.append(lo[1:], n)
    wide = hi - lo > 1
    z = np.zeros(int(wide.sum()), np.int64)
    # a stack of (level, u, v, differing bits), with u, v as ranges; deeper pairs are taken first
    stack = [(depth, lo[wide], hi[wide], lo[wide], hi[wide], z)]
    while stack:
        level, ul, uh, vl, vh, bits = stack.pop()
        if len(ul) > chunk:
            stack.append((level, ul[chunk:], uh[chunk:], vl[chunk:], vh[chunk:], bits[chunk:]))
            ul, uh, vl, vh, bits = ul[:chunk], uh[:chunk], vl[:chunk], vh[:chunk], bits[:chunk]
        until, label = forest.same_until(), forest.label
        open_ = ~((label[ul] == label[vl]) & (until[ul] >= uh) & (until[vl] >= vh))
        ul, uh, vl, vh, bits = ul[open_], uh[open_], vl[open_], vh[open_], bits[open_]
        small = (uh - ul) * (vh - vl) <= 16  # few leaves: compare them all
        if small.any():
            a0, na, b0, nb = ul[small], (uh - ul)[small], vl[small], (vh - vl)[small]
            size = na * nb
            which = np.repeat(np.arange(len(size)), size)
            k = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            a, b = a0[which] + k // nb[which], b0[which] + k % nb[which]
            linked = (a < b) & close(a, b)
            forest.merge(a[linked], b[linked])
            ul, uh, vl, vh, bits = ul[~small], uh[~small], vl[~small], vh[~small], bits[~small]
        if not len(ul):
            continue
        settled = bits + (64 - level) <= budget  # no pair of leaves below can exceed the budget
        if settled.any():
            for a, b, c, d in zip(ul[settled], uh[settled], vl[settled], vh[settled], strict=True):
                both = np.append(np.arange(a, b), np.arange(c, d))
                forest.merge(np.full(len(both), a), both)
            ul, uh, vl, vh, bits = ul[~settled], uh[~settled], vl[~settled], vh[~settled], bits[~settled]
            if not len(ul):
                continue
        um, vm = _split(fps, ul, uh, level), _split(fps, vl, vh, level)
        self_pair = ul == vl
        one = np.ones(len(ul), np.int64)
        kids = [(ul, um, vl, vm, bits, None), (um, uh, vm, vh, bits, None), (ul, um, vm, vh, bits + one, None), (um, uh, vl, vm, bits + one, ~self_pair)]
        parts = []
        for a, b, c, d, e, only in kids:
            keep = (a < b) & (c < d) & (e <= budget) & ~((a == c) & (b - a == 1))
            if only is not None:
                keep &= only
            parts.append((a[keep], b[keep], c[keep], d[keep], e[keep]))
        stack.append((level + 1, *(np.concatenate(x) for x in zip(*parts, strict=True))))
    leaf = np.flatnonzero(forest.label != np.arange(n))
    return forest.label[leaf], leaf


def _split(fps: np.ndarray, lo: np.ndarray, hi: np.ndarray, level: int) -> np.ndarray:
    """First position in each node whose bit at ``level`` is set: a binary search in all nodes at once."""
    bit = np.uint64(1 << (63 - level))
    lo, hi = lo.copy(), hi.copy()
    while (more := lo < hi).any():
        mid = (lo + hi) >> 1
        ones = (fps[np.minimum(mid, len(fps) - 1)] & bit) != 0
        hi = np.where(more & ones, mid, hi)
        lo = np.where(more & ~ones, mid + 1, lo)
    return lo


def links(nodes: DataFrame, *, max_bits: int = 4, subtrie: int = 2048, max_subtrie: int = 200_000) -> DataFrame:
    """(a, b): edges between distinct fingerprints (column fp) that span every component of the link graph."""
    n, m = nodes.count(), 1
    while n / 2 ** (64 * m / (max_bits + m)) > subtrie and m < 8:
        m += 1
    orders = tables(max_bits, m)
    sizes = [sum(len(b) for b in chosen) for chosen in combinations(np.array_split(np.arange(64), max_bits + m), m)]

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for t, (order, bits) in enumerate(zip(orders, sizes, strict=True)):
                p = permuted(fps, order)
                root = (p >> np.uint64(64 - bits)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), t, np.int32)), pa.array(root), pa.array(p.view(np.int64))], ["t", "root", "p"])

    keyed = nodes.select("fp").mapInArrow(key, "t int, root long, p long")

    def solve(x: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for t, y in x.groupby("t", sort=False):
            a, b = subtrie_links(y["p"].to_numpy().view(np.uint64), sizes[t], max_bits, y["subtrie"].to_numpy())
            fps, back = y["p"].to_numpy().view(np.uint64), np.argsort(orders[t])
            yield pd.DataFrame({"a": permuted(fps[a], back).view(np.int64), "b": permuted(fps[b], back).view(np.int64)})

    return in_subtries(keyed, solve, "a long, b long", max_subtrie)


def in_subtries(keyed: DataFrame, solve: Callable[[pd.DataFrame], Iterator[pd.DataFrame]], schema: str, max_subtrie: int) -> DataFrame:
    """What ``solve`` returns for runs of whole subtries of ``keyed`` (t, root, p and further columns).

    ``solve`` gets sorted rows with a further column, subtrie, that numbers their subtries. A subtrie of more than
    ``max_subtrie`` rows is dealt out as pairs of parts, each a subtrie of its own.
    """
    large = written(keyed.groupBy("t", "root").count().where(F.col("count") > max_subtrie), "trie-large").alias("l")
    parts = F.ceil(F.col("count") / (max_subtrie // 2)).cast("int")
    mine = F.pmod(F.xxhash64("p"), parts).cast("int")
    others = F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.struct(F.least(mine, j).alias("i"), F.greatest(mine, j).alias("j")))
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    columns, place = keyed.columns, ["t", "root", "i", "j"]
    dealt = keyed.join(large, ["t", "root"], "left").select(*columns, F.explode(F.when(F.col("count").isNull(), alone).otherwise(others)).alias("part"))
    run = dealt.select(*columns, "part.i", "part.j").repartition(*place).sortWithinPartitions(*place, F.col("p") < 0, "p")

    def numbered(x: pd.DataFrame) -> pd.DataFrame:
        keys = x[place].to_numpy()
        change = np.zeros(len(x), np.int64)
        change[1:] = (keys[1:] != keys[:-1]).any(1)
        return x.assign(subtrie=np.cumsum(change))

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            held.append(pdf)
            if sum(map(len, held)) >= 100_000:  # whole subtries so far are solved, the last one may go on
                x = numbered(pd.concat(held, ignore_index=True))
                last = int(np.searchsorted(x["subtrie"].to_numpy(), x["subtrie"].iloc[-1]))
                if last:
                    yield from solve(x.iloc[:last])
                held = [x.iloc[last:].drop(columns="subtrie")]
        if held:
            yield from solve(numbered(pd.concat(held, ignore_index=True)))

    return run.mapInPandas(join, schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, for all nodes with an edge.

    Each round takes the smallest label of a node's neighbours and then the label of that label, so labels cross
    a component in about log(diameter) rounds; each round ends in a written table.
    """
    both = written(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    state = written(both.groupBy("a").agg(F.min("b").alias("n")).select(F.col("a").alias("node"), F.least("a", "n").alias("root")), "cc-0")
    rounds = 0
    while True:
        rounds += 1
        near = both.join(state.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        lower = state.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        up = state.select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = written(
            lower.join(up, "root").select("node", F.least("root", "above").alias("root"), (F.least("root", "above") != F.col("old")).alias("moved")),
            f"cc-{rounds}",
        )
        state = new.select("node", "root")
        if new.where("moved").isEmpty():
            return state


def clusters(prints: DataFrame, *, max_bits: int) -> DataFrame:
    """(fp, first_id, root) of every distinct fingerprint of ``prints`` (doc_id, fp); root names the component."""
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    member = components(written(links(nodes, max_bits=max_bits), "simhash-links"))
    rooted = nodes.join(member.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return written(rooted, "simhash-components")


def near_duplicates(docs: DataFrame, *, width: int = 4, seed: int = 42, max_bits: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) of each row of ``docs``; component_id is the smallest id that links reach."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = written(fingerprints(rows, width=width, seed=seed).select("doc_id", "fp"), "simhash")
    found = clusters(prints, max_bits=max_bits)
    smallest = found.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of = written(found.join(smallest, "root").select("fp", "component_id"), "simhash-smallest")
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")


def hex_fp(fp: str) -> Column:
    """16 lower-case hex digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(docs: DataFrame, *, width: int = 5, max_bits: int = 4) -> DataFrame:
    """``docs`` without all but one document of each component.

    The document with the smallest id stays (a null id comes last); of rows with that id and fingerprint, the one
    whose other columns are smallest. The rows are shuffled once, by id and fingerprint, which no group makes hot.
    """
    columns, fp, rank = docs.columns, free_name(docs, "simhash_fp"), free_name(docs, "simhash_rank")
    tagged = written(fingerprints(docs, width=width, name=fp), "simhash-tagged")
    found = clusters(tagged.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(fp).alias("fp")), max_bits=max_bits)
    first = F.min(F.struct(F.col("first_id").isNull().alias("last"), "first_id", "fp")).alias("k")
    keep = found.groupBy("root").agg(first).select(F.col("k.first_id").alias("keep_id"), F.col("k.fp").alias("keep_fp"))
    k = keep.alias("k")
    kept = tagged.alias("d").join(k, (F.col(f"d.{fp}") == F.col("k.keep_fp")) & F.col("d.doc_id").eqNullSafe(F.col("k.keep_id")), "left_semi")
    w = W.partitionBy(fp, "doc_id").orderBy(*(order_key(f) for f in docs.schema if f.name != "doc_id"))
    return kept.withColumn(rank, F.row_number().over(w)).where(F.col(rank) == 1).select(*columns)
