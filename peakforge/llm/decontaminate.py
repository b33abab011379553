"""Benchmark decontamination: passages of a benchmark within an edit budget, found by the q-gram lemma.

An item of m letters that occurs with at most k edits shares at least m + 1 - q - k * q of its q-grams with the
text, all on diagonals that differ by at most k. So shared q-grams are counted in bands of 2 * (k + 1) diagonals, each
overlapping the next by half; bands that reach the bound are aligned with the item in a band of diagonals, and
those within the budget are returned. The filter loses no occurrence and the alignment admits no other.

Grams whose places in the items are the same but for a shift form one class, so all hits of an item, or of a preamble that
thousands of items share, on one diagonal are one weighted hit before they are multiplied by the items. What is left of a
preamble passes the bound for every item that has it; a first alignment, costs alone, starts at the end of the item that has fewer
hits and drops a pair once the budget is exceeded. Counts are made for as many texts and items at a time as ``MOST_HITS`` allows. (At 9 % edits
and q = 9 the rarest k * q + 1 grams of an item are four in five of all, so opening bands by them alone would save nothing.)

Texts are compared as lower-case letters and digits with single spaces for all else. Items of fewer than ``min_chars`` letters
have no budget: they are found as whole words without edits. The index of an item block is broadcast: about 30 bytes for each of
at most ``block_chars`` letters and the last item. A larger benchmark is searched block by block, each against all documents, and the rows of each
block are written before the next one is sent.

Defined cases: null and empty texts match nothing, nor do items without a letter or digit; null ids and repeated rows are returned as they come, an item that occurs twice
in a text gives two rows; an empty table on either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakforge.llm.common import written

PRIME = 0x9E3779B97F4A7C15
FILTER_BITS = 22
MOST_HITS = 4_000_000  # weighted hits that are counted together
MOST_CELLS = 4_000_000  # letters and diagonals of pairs that are aligned together


@cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Lower case, and whether it is a letter or digit, of each code point of the basic plane."""
    lower, word = np.arange(1 << 16, dtype=np.uint32), np.zeros(1 << 16, bool)
    for k in range(1 << 16):
        c = chr(k)
        low = c.lower()
        word[k] = c.isalnum()
        if len(low) == 1:
            lower[k] = ord(low)
    return lower, word


def letters(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of ``text`` as it is compared, and the place of each in ``text``. NULs stay, as ends of texts."""
    lower, word = _characters()
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    basic = np.minimum(raw, 0xFFFF)
    is_word = word[basic] | (raw > 0xFFFF)
    keep = is_word.copy()
    keep[1:] |= is_word[:-1]  # the first other character after a word stands for the gap
    keep |= raw == 0
    at = np.flatnonzero(keep)
    kept = raw[at]
    shown = np.where(kept > 0xFFFF, kept, lower[np.minimum(kept, 0xFFFF)])
    shown = np.where(is_word[at], shown, np.where(kept == 0, 0, 32))
    return shown.astype(np.uint32), at


def hashes(c: np.ndarray, q: int) -> np.ndarray:
    """Polynomial hashes of all q-grams, by doubling."""
    with np.errstate(over="ignore"):
        h, n, out, done = c.astype(np.uint64), 1, None, 0
        while True:
            if q & n:
                if out is None:
                    out, done = h, n
                else:
                    size = len(c) - done - n + 1
                    out = out[: max(0, size)] * np.uint64(pow(PRIME, n, 1 << 64)) + h[done : done + max(0, size)]
                    done += n
            if done == q:
                return out[: max(0, len(c) - q + 1)]
            size = max(0, len(c) - 2 * n + 1)
            h, n = h[:size] * np.uint64(pow(PRIME, n, 1 << 64)) + h[n : n + size], 2 * n


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        return x ^ (x >> np.uint64(27))


@dataclass
class Index:
    """q-grams of a block of items: gram -> class and shift, class -> (item, place before the shift)."""

    q: int
    ids: list[int]
    items: list[np.ndarray]
    budgets: np.ndarray
    whole: np.ndarray  # items that have to stand as whole words
    grams: np.ndarray  # distinct hashes, sorted
    cls: np.ndarray
    shift: np.ndarray
    first: np.ndarray  # per class, its first entry of item and rel; one more at the end
    item: np.ndarray
    rel: np.ndarray
    maybe: np.ndarray  # a table of hash prefixes
    tiny: dict[int, dict[int, list[int]]]  # length -> hash -> items of fewer than q letters
    parts: tuple | None = None

    @classmethod
    def build(cls, rows: list[tuple[int, str]], q: int, rate: float, min_chars: int) -> Index | None:
        ids, items = [], []
        for k, text in rows:
            c, _ = letters((text or "").replace("\0", " "))
            c = c[:-1] if len(c) and c[-1] == 32 else c
            if len(c):
                ids.append(k)
                items.append(c)
        return cls.of(ids, items, q, rate, min_chars) if items else None

    @classmethod
    def of(cls, ids: list[int], items: list[np.ndarray], q: int, rate: float, min_chars: int) -> Index:
        sizes = np.array([len(c) for c in items])
        budgets = np.where(sizes < min_chars, 0, np.minimum((rate * sizes).astype(int), np.maximum(sizes - q, 0) // q))
        hs = [hashes(c, q) for c in items]
        counts = [len(x) for x in hs]
        h, item = np.concatenate(hs), np.repeat(np.arange(len(items)), counts)
        place = np.concatenate([np.arange(n) for n in counts])
        order = np.lexsort((place, item, h))
        h, item, place = h[order], item[order], place[order]
        grams, first, count = np.unique(h, return_index=True, return_counts=True)
        maybe = np.zeros(1 << FILTER_BITS, bool)
        maybe[grams >> np.uint64(64 - FILTER_BITS)] = True
        shift = place[first] if len(first) else first
        rel = place - np.repeat(shift, count)
        with np.errstate(over="ignore"):
            mark = _mix(_mix(item.astype(np.uint64) + np.uint64(1)) + rel.astype(np.uint64) * np.uint64(PRIME))
            mark = np.add.reduceat(mark, first) + count.astype(np.uint64) if len(first) else mark
        _, of, kind = np.unique(mark, return_index=True, return_inverse=True)
        size = count[of]
        flat = np.repeat(first[of] - np.cumsum(size) + size, size) + np.arange(size.sum())
        tiny: dict[int, dict[int, list[int]]] = {}
        for k, c in enumerate(items):
            if len(c) < q:
                tiny.setdefault(len(c), {}).setdefault(int(hashes(c, len(c))[0]), []).append(k)
        narrow = lambda x: x.astype(np.int32)
        return cls(
            q, ids, items, budgets, sizes < min_chars, grams, narrow(kind), narrow(shift), np.append(0, np.cumsum(size)), narrow(item[flat]), narrow(rel[flat]), maybe, tiny
        )

    def halves(self) -> tuple[Index, Index]:
        """The index of the first and of the other half of the items, made once."""
        if self.parts is None:
            m, made = len(self.items) // 2, []
            for part in (slice(0, m), slice(m, None)):
                x = Index.of(self.ids[part], self.items[part], self.q, 0.0, 0)
                x.budgets, x.whole = self.budgets[part], self.whole[part]
                made.append(x)
            self.parts = tuple(made)
        return self.parts


def within(items: list[np.ndarray], texts: list[np.ndarray], lows: list[int], width: int, budgets: list[int]) -> np.ndarray:
    """Which items occur in their texts within their budgets on diagonals low .. low + width - 1: costs alone, and no further than needed."""
    order = np.array(sorted(range(len(items)), key=lambda k: len(items[k])))
    sizes = np.array([len(items[k]) for k in order])
    low, ends, most = np.array(lows)[order], np.array([len(texts[k]) for k in order]), np.array(budgets)[order]
    longest, kind = int(sizes[-1]), np.int16 if sizes[-1] + width < 30_000 else np.int32
    far = np.iinfo(kind).max // 2
    letters_ = np.zeros((len(order), longest), np.uint32)
    shown = np.zeros((len(order), longest + width), np.uint32)
    for n, k in enumerate(order):
        letters_[n, : sizes[n]] = items[k]
        part = texts[k][max(0, low[n]) : max(0, low[n]) + shown.shape[1] - max(0, -low[n])]
        shown[n, max(0, -low[n]) : max(0, -low[n]) + len(part)] = part
    step = np.arange(width).astype(kind)
    at = low[:, None] + np.arange(width)
    best = np.where((at >= 0) & (at <= ends[:, None]), 0, far).astype(kind)
    out, live = np.zeros(len(order), bool), np.arange(len(order))
    for i in range(longest):
        row = best + (shown[:, i : i + width] != letters_[:, i, None])
        np.minimum(row[:, :-1], best[:, 1:] + 1, out=row[:, :-1])
        row -= step
        np.minimum.accumulate(row, 1, out=row)
        row += step
        best = row.astype(kind, copy=False)
        done = np.searchsorted(sizes[live], i + 1, side="right")  # those that end here are the first ones
        if done:
            stop = low[live[:done], None] + i + 1 + np.arange(width)
            fits = (best[:done] <= most[live[:done], None]) & (stop >= 0) & (stop <= ends[live[:done], None])
            out[order[live[:done]]] = fits.any(1)
        if done or i % 8 == 7:
            keep = best.min(1) <= most[live]
            keep[:done] = False
            if done or 4 * keep.sum() < 3 * len(keep):
                best, shown, letters_, live = best[keep], shown[keep], letters_[keep], live[keep]
        if not len(live):
            break
    return out


def align(items: list[np.ndarray], texts: list[np.ndarray], lows: list[int], width: int) -> list[tuple[int, int, int]]:
    """(edits, start, end) of the best occurrence of each item in its text on diagonals low .. low + width - 1.

    All pairs advance together, a row of costs per letter of the items; the start of an occurrence rides along in the
    lower bits. Longer items come first, so those that are done drop off the end.
    """
    big, far = 1 << 32, 1 << 60
    order = sorted(range(len(items)), key=lambda k: -len(items[k]))
    sizes = np.array([len(items[k]) for k in order])
    low, ends = np.array([lows[k] for k in order]), np.array([len(texts[k]) for k in order])
    letters_ = np.zeros((len(order), sizes[0]), np.uint32)
    shown = np.zeros((len(order), sizes[0] + width), np.uint32)  # text from the first diagonal on; 0 is no letter
    for n, k in enumerate(order):
        letters_[n, : sizes[n]] = items[k]
        part = texts[k][max(0, low[n]) : max(0, low[n]) + shown.shape[1] - max(0, -low[n])]
        shown[n, max(0, -low[n]) : max(0, -low[n]) + len(part)] = part
    step = np.arange(width, dtype=np.int64) * big
    at = low[:, None] + np.arange(width)
    best = np.where((at >= 0) & (at <= ends[:, None]), np.arange(width, dtype=np.int64), far)
    done = np.empty_like(best)
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # items with more letters than i
    for i in range(sizes[0]):
        n = active[i]
        best = best[:n]
        row = best + np.where(shown[:n, i : i + width] == letters_[:n, i, None], 0, big)
        np.minimum(row[:, :-1], best[:, 1:] + big, out=row[:, :-1])
        row -= step
        best = np.minimum.accumulate(row, 1, out=row)
        best += step
        over = n if i + 1 == sizes[0] else n - active[i + 1]
        if over:
            first = 0 if i + 1 == sizes[0] else active[i + 1]
            done[first:n] = best[first:n]
    stop = low[:, None] + sizes[:, None] + np.arange(width)
    done = np.where((stop >= 0) & (stop <= ends[:, None]), done, far)
    col = np.argmin(done >> 32, 1)
    value = done[np.arange(len(order)), col]
    out: list = [None] * len(order)
    for n, k in enumerate(order):
        out[k] = (int(value[n] >> 32), int(low[n] + (value[n] & (big - 1))), int(stop[n, col[n]]))
    return out


def counted(c: np.ndarray, index: Index, many: bool) -> tuple[np.ndarray, ...] | None:
    """(item, first diagonal of the band, whether hits lie in the item's first half) of each band that reaches its bound.

    None if that takes more than MOST_HITS weighted hits and ``many`` says that it can be divided.
    """
    h = hashes(c, index.q)
    hit = np.flatnonzero(index.maybe[h >> np.uint64(64 - FILTER_BITS)])
    gram = np.minimum(np.searchsorted(index.grams, h[hit]), max(0, len(index.grams) - 1))
    real = index.grams[gram] == h[hit] if len(index.grams) else np.zeros(len(hit), bool)
    hit, gram = hit[real], gram[real]
    if not len(hit):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)
    size = np.array([len(x) for x in index.items])
    base, shift = int(size.max()) + 1, index.shift[gram].astype(np.int64)
    span = len(c) + 2 * base
    key = index.cls[gram].astype(np.int64) * span + (hit - shift + base)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    weight, place = np.diff(np.append(first, len(key))), np.add.reduceat(shift[order], first)
    kind, diagonal = key[first] // span, key[first] % span - base
    n = index.first[kind + 1] - index.first[kind]
    if many and n.sum() > MOST_HITS:
        return None
    of = np.repeat(np.arange(len(n)), n)
    flat = np.repeat(index.first[kind] - np.cumsum(n) + n, n) + np.arange(n.sum())
    item, rel = index.item[flat].astype(np.int64), index.rel[flat].astype(np.int64)
    stride = index.budgets[item] + 1
    cell = item * span + (diagonal[of] - rel + base) // stride
    order = np.argsort(cell, kind="stable")
    cell, of, rel = cell[order], of[order], rel[order]
    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    hits, places = np.add.reduceat(weight[of], first), np.add.reduceat(place[of] + weight[of] * rel, first)
    cell = cell[first]
    pair = np.append(cell[1:] == cell[:-1] + 1, False)  # a band is a cell with the next; one that starts empty adds nothing
    both = hits + np.where(pair, np.append(hits[1:], 0), 0)
    places = places + np.where(pair, np.append(places[1:], 0), 0)
    which = cell // span
    passed = both >= (size + 1 - index.q - index.budgets * index.q)[which]
    which = which[passed]
    return which, cell[passed] % span * (index.budgets[which] + 1) - base, 2 * places[passed] < size[which] * both[passed]


def bands(texts: list[str | None], index: Index) -> dict[tuple[int, int], list[tuple[int, int, int]]]:
    """(text, item) -> (edits, start, end) of what the bands hold, places counted in ``letters`` of each text."""
    c, _ = letters("\0".join((t or "").replace("\0", " ") for t in texts))
    got = counted(c, index, len(texts) > 1 or len(index.items) > 1)
    if got is None:
        found = {}
        if len(texts) > 1:
            m = len(texts) // 2
            found |= bands(texts[:m], index)
            found |= {(t + m, k): v for (t, k), v in bands(texts[m:], index).items()}
        else:
            m = len(index.items) // 2
            one, other = index.halves()
            found |= bands(texts, one)
            found |= {(t, k + m): v for (t, k), v in bands(texts, other).items()}
        return found
    ends = np.append(np.flatnonzero(c == 0), len(c))
    begins = np.append(0, ends[:-1] + 1)
    pairs: dict[tuple[int, int, int], bool] = {}
    for k, d, front in zip(*(x.tolist() for x in got), strict=True):
        budget, m = int(index.budgets[k]), len(index.items[k])
        near = np.searchsorted(ends, [max(0, d + m // 2), max(0, d - budget), min(len(c), d + m + 2 * budget)])
        pairs.update(((int(t), k, d), front) for t in near if t < len(ends))
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    tried = sorted(pairs, key=lambda x: -len(index.items[x[1]]))
    at = 0
    while at < len(tried):
        longest = len(index.items[tried[at][1]])
        part = tried[at : at + max(1, MOST_CELLS // (longest + 4 * int(index.budgets[tried[at][1]]) + 3))]
        at += len(part)
        budgets = [int(index.budgets[k]) for _, k, _ in part]
        width = 4 * max(budgets) + 3
        items, windows, lows, shifts = [], [], [], []
        for (t, k, d), budget in zip(part, budgets, strict=True):
            a = int(begins[t])
            begin = max(0, d - a - budget)
            items.append(index.items[k])
            windows.append(c[a : int(ends[t])][begin : d - a + len(index.items[k]) + 4 * budget + 4])
            lows.append(min(0, d - a - budget))
            shifts.append(begin)
        turned = [(x[::-1], w[::-1], len(w) - len(x) - low - width + 1) if pairs[p] else (x, w, low) for p, x, w, low in zip(part, items, windows, lows, strict=True)]
        good = np.flatnonzero(within([x for x, _, _ in turned], [w for _, w, _ in turned], [v for _, _, v in turned], width, budgets)).tolist()
        for g in range(0, len(good), 256):
            some = good[g : g + 256]
            aligned = align([items[n] for n in some], [windows[n] for n in some], [lows[n] for n in some], width)
            for n, (edits, start, end) in zip(some, aligned, strict=True):
                t, k, _ = part[n]
                start, end = start + shifts[n], end + shifts[n]
                if edits <= budgets[n] and end > start and (not index.whole[k] or _whole(c[begins[t] : ends[t]], start, end)):
                    found.setdefault((t, k), []).append((edits, start, end))
    for size, table in index.tiny.items():
        for p, h in enumerate(hashes(c, size).tolist()):
            if h in table:
                t = int(np.searchsorted(ends, p))
                start = p - int(begins[t])
                if p + size <= ends[t] and _whole(c[begins[t] : ends[t]], start, start + size):
                    for k in table[h]:
                        if (index.items[k] == c[p : p + size]).all():
                            found.setdefault((t, k), []).append((0, start, start + size))
    return found


def _whole(c: np.ndarray, start: int, end: int) -> bool:
    return (start == 0 or c[start - 1] == 32) and (end == len(c) or c[end] == 32)


def search(texts: list[str | None], index: Index) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) of every occurrence, overlapping ones of an item merged to the best."""
    out, places = [], {}
    for (t, k), spans in bands(texts, index).items():
        if t not in places:
            places[t] = letters((texts[t] or "").replace("\0", " "))[1]
        place, taken = places[t], []
        for edits, start, end in sorted(set(spans)):
            if all(end <= a or start >= b for a, b in taken):
                taken.append((start, end))
                out.append((t, index.ids[k], int(place[start]), int(place[end - 1] + 1), edits))
    return out


def blocks(benchmark: DataFrame, *, q: int, rate: float, min_chars: int, block_chars: int) -> Iterator[Index]:
    """Indexes of the benchmark's items, in blocks of bounded size; the driver holds one block at a time."""
    rows, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL").toLocalIterator():
        rows.append((r[0], r[1]))
        size += len(r[1])
        if size >= block_chars:
            if index := Index.build(rows, q, rate, min_chars):
                yield index
            rows, size = [], 0
    if index := Index.build(rows, q, rate, min_chars):
        yield index


def pieces(batch: pa.RecordBatch, rows: int = 100, size: int = 500_000) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of at most so many rows with texts of about ``size`` bytes; a longer text stands alone."""
    lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < batch.num_rows:
        n = int(np.searchsorted(np.cumsum(lengths[at : at + rows]), size)) or 1
        yield batch.slice(at, n)
        at += n


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, q: int = 9, rate: float = 0.09, min_chars: int = 30, block_chars: int = 2_000_000
) -> DataFrame:
    """(doc_id, item_id, start, end, edits): every occurrence of an item with at most ``rate`` edits a letter.

    ``start`` and ``end`` are code points of the document's text.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())])
    ddl = "doc_id long, item_id long, start long, end long, edits int"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def one(index: Index) -> tuple[DataFrame, Broadcast]:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part in pieces(b):
                    ids = part.column("doc_id").to_pylist()
                    found = [(ids[t], *rest) for t, *rest in search(part.column("text").to_pylist(), shared.value)]
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in found], schema)

        return rows.mapInArrow(run, ddl), shared

    parts = in_turn(blocks(benchmark, q=q, rate=rate, min_chars=min_chars, block_chars=block_chars), one, "contaminated")
    return functools.reduce(DataFrame.union, parts, docs.sparkSession.createDataFrame([], ddl)) if len(parts) != 1 else parts[0]


def in_turn(indexes: Iterator[Index], one: Callable[[Index], tuple[DataFrame, Broadcast]], name: str) -> list[DataFrame]:
    """What ``one`` makes of each index. Of several, each is written, and its broadcast dropped, before the next one is made."""
    out: list[DataFrame] = []
    index = next(indexes, None)
    while index is not None:
        found, shared = one(index)
        index = next(indexes, None)
        if out or index is not None:
            found = written(found, name)
            shared.destroy()
        out.append(found)
    return out


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, *, q: int = 9, rate: float = 0.09, min_chars: int = 30, block_chars: int = 2_000_000
) -> DataFrame:
    """``docs`` without the rows in which an item occurs; rows pass through the search, so nothing is shuffled.

    Of several blocks of the benchmark each is searched by itself: what it leaves is written, and its broadcast dropped, before the next one is made.
    """

    def one(index: Index) -> tuple[DataFrame, Broadcast]:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part in pieces(b):
                    clean = np.ones(part.num_rows, bool)
                    clean[[t for t, *_ in search(part.column("text").to_pylist(), shared.value)]] = False
                    yield part.filter(pa.array(clean))

        return docs.mapInArrow(run, docs.schema), shared

    indexes = blocks(benchmark, q=q, rate=rate, min_chars=min_chars, block_chars=block_chars)
    index, before = next(indexes, None), 0
    while index is not None:
        left, shared = one(index)
        index, before = next(indexes, None), before + 1
        if before > 1 or index is not None:
            left = written(left, "decontaminated")
            shared.destroy()
        docs = left
    return docs
