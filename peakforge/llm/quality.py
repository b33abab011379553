"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each document gets counts over its whole text. Per language and source, a log-bucket sketch of every metric gives
fences that replace fixed cut-offs. A sketch is a table of (group, metric, bucket, count): two sketches merge by adding counts, so
the result depends neither on the order of rows nor on the partitioning, and the relative error is bounded by
``GAMMA``.

Defined cases: a null text has no words and fails the base rules; null lang or source form groups of their own; an
empty table gives no rows; repeated ids are judged row by row; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakforge.llm.common import written

GAMMA = 1.02
UNIT = 1000
SYMBOLS = re.compile(r"[#*$%&|<>]")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: metric -> (numerator, denominator); a document is judged by its upper fences, and by both for word length.
METRICS = {
    "symbol_rate": ("n_symbols", "n_words"),
    "dup_line_rate": ("n_dup_lines", "n_words"),
    "repeat_rate": ("n_repeat_words", "n_words"),
    "word_length": ("word_chars", "n_words"),
}


def repeat_words(ids: np.ndarray, width: int = 5) -> int:
    """Words that lie in a window of ``width`` words which occurs twice or more, the first occurrence included."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    top = int(ids.max()) + 1
    key = ids.astype(np.int64)[:n]
    size = top
    for k in range(1, width):
        if size > (1 << 62) // top:  # ranks instead of numbers too large for 64 bits
            _, key = np.unique(key, return_inverse=True)
            size = n
        key = key * top + ids[k : k + n]
        size *= top
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """COUNTS of one text. Words are runs of characters other than ASCII white space."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return 0, 0, len(SYMBOLS.findall(text)), 0, 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(raw) == len(text):
        chars = sum(map(len, words))
    else:
        data = np.frombuffer(raw, np.uint8)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        chars = int(((data & 0xC0) != 0x80).sum() - space.sum())
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(words), chars, len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeat_words(ids)


def with_counts(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, lang, source, COUNTS...) of each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("source", pa.string()), *((c, pa.int64()) for c in COUNTS)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [text_counts(t.as_py()) for t in b.column("text")]
            cols = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), b.column("source"), *cols], schema=schema)

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string")
    ).mapInArrow(count, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def bucket(value: Column) -> Column:
    """Log bucket of a value; values up to 1e-6 share the lowest one."""
    return F.ceil(F.log(F.greatest(value, F.lit(1e-6))) / math.log(GAMMA)).cast("int")


def bucket_value(b: Column) -> Column:
    """The value that stands for a bucket, within (GAMMA-1)/(GAMMA+1) of all that fall in it."""
    return F.pow(F.lit(GAMMA), b) * (2 / (1 + GAMMA))


def sketches(rows: DataFrame, group: list[str], metrics: dict[str, Column]) -> DataFrame:
    """(group..., metric, bucket, n): counts per bucket, summed in each task before the shuffle."""
    long = rows.select(*group, F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), bucket(v).alias("bucket")) for k, v in metrics.items()))).alias("m"))
    return long.select(*group, "m.*").groupBy(*group, "metric", "bucket").agg(F.count("*").alias("n"))


def merge(sketch: DataFrame, group: list[str]) -> DataFrame:
    """Merge sketches of finer groups into coarser ones by adding counts."""
    return sketch.groupBy(*group, "metric", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, group: list[str], qs: dict[str, float]) -> DataFrame:
    """(group..., metric, n, <name of each quantile>): the bucket that holds rank q * (n - 1)."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*group, "metric")
    run = F.sum("n").over(w.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
    ranked = sketch.withColumns({"run": run, "total": F.sum("n").over(w)})
    out = {k: F.min(F.when(F.col("run") > q * (F.col("total") - 1), F.col("bucket"))) for k, q in qs.items()}
    return ranked.groupBy(*group, "metric").agg(F.first("total").alias("n"), *(bucket_value(v).alias(k) for k, v in out.items()))


def blend(sketch: DataFrame, wide: DataFrame, shared: list[str], group: list[str], prior: int) -> DataFrame:
    """The sketch of each ``group`` with that of the wider group around it (columns ``shared``), scaled to ``prior`` documents.

    Counts are in units of 1 / ``UNIT`` documents, whole numbers, so that sums don't depend on their order.
    """
    size = wide.groupBy(*shared, "metric").agg(F.sum("n").alias("all_n"))
    same = lambda x, y: functools.reduce(lambda a, b: a & b, [F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{c}")) for c in [*shared, "metric"]])
    scaled = wide.alias("w").join(size.alias("s"), same("w", "s")).select("w.*", F.round(F.col("n") * prior * UNIT / F.col("all_n")).cast("long").alias("part"))
    groups = sketch.select(*group, "metric").distinct()
    around = groups.alias("g").join(scaled.alias("w"), same("g", "w")).select(*(f"g.{c}" for c in group), "g.metric", "w.bucket", F.col("w.part").alias("n"))
    return merge(sketch.withColumn("n", F.col("n") * UNIT).select(*around.columns).union(around), group)


def adaptive_filter(
    docs: DataFrame,
    *,
    min_words: int = 10,
    max_repeat_percent: int = 20,
    prior: int = 200,
    fence: float = 4.0,
    slack: float = 0.02,
    word_slack: float = 1.0,
) -> DataFrame:
    """Counts, base_failed and kept for every document.

    A document is kept if it passes the base rules and every metric lies within the fences of its (lang, source):
    quartile + ``fence`` * interquartile range + slack. The quartiles are those of the group's sketch blended with that of
    its language, which counts as ``prior`` documents; a language's sketch is blended with that of all documents alike. So a
    small group leans on its language, a large one on itself, and no size switches from one to the other.
    """
    counts = written(with_counts(docs), "quality-counts")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    rows = counts.withColumn("base_failed", failed)
    values = {k: F.col(a) / F.greatest(F.col(b), F.lit(1)) for k, (a, b) in METRICS.items()}
    fine = written(sketches(rows.where(~F.col("base_failed")), ["lang", "source"], values), "quality-sketch")
    by_lang = written(blend(merge(fine, ["lang"]), merge(fine, []), [], ["lang"], prior), "quality-sketch-lang")
    own = quantiles(blend(fine, by_lang, ["lang"], ["lang", "source"], prior), ["lang", "source"], {"q1": 0.25, "q3": 0.75})
    pad = F.when(F.col("metric") == "word_length", F.lit(word_slack)).otherwise(F.lit(slack))
    reach = fence * (F.col("q3") - F.col("q1")) + pad
    chosen = own.select("lang", "source", "metric", F.struct((F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high")).alias("f"))
    table = written(
        chosen.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("metric", "f"))).alias("fences")),  # as many entries as there are metrics
        "quality-fences",
    ).alias("t")
    joined = rows.alias("r").join(table, F.col("r.lang").eqNullSafe(F.col("t.lang")) & F.col("r.source").eqNullSafe(F.col("t.source")), "left")
    within = F.lit(True)
    for k, v in values.items():
        f = F.col("fences")[k]
        within &= v <= f["high"]
        if k == "word_length":
            within &= v >= f["low"]
    return joined.select("doc_id", "r.lang", "r.source", *COUNTS, "base_failed", F.coalesce(~F.col("base_failed") & within, F.lit(False)).alias("kept"))
