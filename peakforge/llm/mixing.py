"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Documents of a source stand in a fixed shuffled order (md5 of the id and of the text), pass after pass. A document's virtual finish
time is the number of words its source has given up to it, divided by the source's weight. All documents are ordered
by finish time, and the mix is what comes before the total budget is used up.

Prefix sums run in two levels, so that neither a large source nor the whole order lies in one task: a source of n
documents is cut into about sqrt(n) buckets of its shuffled order, and so is the order of finish times; sums of
buckets are accumulated first, what is inside a bucket after that. Only one in ``CELLS`` of the bucket that holds the cut is ordered row
by row.

Rows that agree in source, id and text stand one after the other. They are one group with a number, counted before any shuffle: the k-th of them ends k sizes
after the group's begin, so how many of them lie before a place is a division, and a group of any size is one row until the plan is dealt out in stretches of ``STRETCH``.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; null ids are shuffled as
the empty text; equal rows are taken one by one, and which of them is not told; sizes of 0
give nothing; an empty table gives no rows; all weights, the budget share and the number of passes are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from peakforge.llm.common import free_name, written

WORD = r"[^\x20\x09-\x0D]+"
CELLS, STRETCH = 1024, 10_000


def shuffled() -> Column:
    """A document's place in shuffled order: the md5 of its id and of the md5 of its text, so repeated ids are spread too."""
    text = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit(" "), text).cast("binary"))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, shuffle): the words of each whole text and the document's place in shuffled order."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        shuffled().alias("shuffle"),
    )


def source_targets(rows: DataFrame, weights: tuple[int, ...], share: float, passes: int) -> DataFrame:
    """(source, place, weight, source_size, n_docs, level, target) for each source of (source, size, m).

    ``level`` is the finish time at which the budget is used up if sources stop at ``passes`` times their size:
    sources ordered by the time at which they stop, those that stop before the level are full, the others share.
    """
    per = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.sum("m").alias("n_docs"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())  # one row for each source
    per = per.withColumn("place", F.row_number().over(by_name).cast("long"))
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    per = per.withColumn("weight", F.element_at(cycle, ((F.col("place") - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", (F.lit(passes) * F.col("source_size")).cast("double"))
    order = W.orderBy(F.col("cap") / F.col("weight"), "place")
    every = W.partitionBy()
    per = per.withColumns(
        {
            "budget": F.least(F.lit(share) * F.sum("source_size").over(every), F.sum("cap").over(every)),
            "before": F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
            "sharing": F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)),
        }
    ).withColumn("reach", (F.col("budget") - F.col("before")) / F.col("sharing"))
    full = F.col("cap") / F.col("weight") <= F.col("reach")
    per = per.withColumn("level", F.min(F.when(~full, F.struct(F.col("before"), F.col("reach")))).over(every)["reach"])
    target = F.when(full | F.col("level").isNull(), F.col("cap")).otherwise(F.col("weight") * F.col("level"))
    return per.select("source", "place", "weight", "source_size", "n_docs", "level", "budget", target.alias("target"))


def grouped_plan(docs: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, passes: int = 2) -> DataFrame:
    """(source, shuffle, doc_id, size, m, source_size, target, taken_0, taken_1 ...) of each group of equal rows.

    ``taken_p`` says how many of the ``m`` rows the mix holds a (p + 1)-th time; they are the first ones of the group.
    """
    same = sized(docs).groupBy("source", "shuffle").agg(F.min("doc_id").alias("doc_id"), F.min("size").alias("size"), F.count("*").alias("m"))
    rows = written(same, "mix-groups")
    sources = written(source_targets(rows, weights, share, passes), "mix-sources").alias("s")
    known = rows.alias("r").join(sources, F.col("r.source").eqNullSafe(F.col("s.source"))).drop(F.col("s.source"))
    high = F.conv(F.substring("shuffle", 1, 8), 16, 10).cast("long")
    cuts = F.ceil(F.sqrt("n_docs")).cast("long")
    known = known.withColumn("bucket", F.floor(high * cuts / F.lit(float(1 << 32))).cast("long"))
    words = F.col("size") * F.col("m")
    parts = known.groupBy("place", "bucket").agg(F.sum(words).alias("part"))
    run = W.partitionBy("place").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("place", "bucket", F.coalesce(F.sum("part").over(run), F.lit(0)).alias("earlier"))
    inside = W.partitionBy("place", "bucket").orderBy("shuffle").rowsBetween(W.unboundedPreceding, 0)
    queued = written(
        known.join(parts, ["place", "bucket"])
        .withColumn("before", F.col("earlier") + F.sum(words).over(inside) - words)
        .select("doc_id", "source", "size", "m", "shuffle", "place", "weight", "source_size", "target", "level", "budget", "before"),
        "mix-queued",
    )
    told = queued.agg(F.sum("m").alias("n"), F.max("level").alias("level"), F.max("budget").alias("budget")).first()
    everything = [F.col("m")] * passes
    if told["level"] is None:  # the budget holds every pass of every source
        taken = everything
    else:
        taken = cut_of(queued, told["n"], told["level"] or 1.0, told["budget"], passes) or everything
    kept = [F.when(F.col("size") > 0, t).otherwise(0).cast("long").alias(f"taken_{k}") for k, t in enumerate(taken)]
    return queued.select("source", "shuffle", "doc_id", "size", "m", "source_size", "target", *kept)


def cut_of(queued: DataFrame, n: int, level: float, budget: float, passes: int) -> list[Column] | None:
    """How many rows of a group come before the budget is used up, for each pass; None if it never is."""
    slots = max(1, round((passes * n) ** 0.5))
    cells = float(slots * CELLS)

    def finish(k: Column, p: Column) -> Column:
        """The finish time of the k-th row of a group in pass ``p``."""
        return (F.col("before") + k * F.col("size") + p * F.col("source_size")) / F.col("weight")

    def cell(k: Column, p: Column) -> Column:
        return F.floor(F.least(finish(k, p) / F.lit(level) * F.lit(cells), F.lit(2 * cells))).cast("long")

    def first(test, guess: Column) -> Column:
        """The number of rows, from 1 on, that meet a test which none meets after one that does not; ``guess`` is off by one at most, from rounding."""
        g = F.greatest(F.lit(0), F.least(F.col("m"), F.floor(guess))).cast("long")
        meets = lambda k: ((k <= 0) | ((k <= F.col("m")) & test(k))).cast("long")
        return g - 1 + meets(g) + meets(g + 1)

    def rows_until(time: Column, p: Column) -> Column:
        return (time * F.col("weight") - F.col("before") - p * F.col("source_size")) / F.col("size")

    def below(bound: Column, p: Column) -> Column:
        """Rows of the group in cells below ``bound``."""
        return first(lambda k: cell(k, p) < bound, rows_until(bound / F.lit(cells) * F.lit(level), p))

    one, p = F.lit(1).cast("long"), F.col("pass")
    line = queued.where("size > 0").withColumn("pass", F.explode(F.array(*(F.lit(k) for k in range(passes)))))
    line = line.withColumns({"low": cell(one, p), "high": cell(F.col("m"), p)})
    slot = lambda c: F.floor(F.col(c) / CELLS).cast("long")
    pieces = line.withColumn("slot", F.explode(F.sequence(slot("low"), slot("high"))))
    whole = F.when(slot("low") == slot("high"), F.col("m")).otherwise(below((F.col("slot") + 1) * CELLS, p) - below(F.col("slot") * CELLS, p))
    sums = pieces.groupBy("slot").agg(F.sum(F.col("size") * whole).alias("part"))
    upto = F.sum("part").over(W.orderBy("slot").rowsBetween(W.unboundedPreceding, 0))  # one row for each slot
    cut = sums.withColumn("upto", upto).where(F.col("upto") > budget).orderBy("slot").limit(1).first()
    if cut is None:
        return None
    rest, start = budget - (cut["upto"] - cut["part"]), cut["slot"] * CELLS
    here = line.where((F.col("low") < start + CELLS) & (F.col("high") >= start))
    pieces = here.withColumn("cell", F.explode(F.sequence(F.greatest("low", F.lit(start)), F.least("high", F.lit(start + CELLS - 1)))))
    sums = pieces.groupBy("cell").agg(F.sum(F.col("size") * (below(F.col("cell") + 1, p) - below(F.col("cell"), p))).alias("part"))
    upto = F.sum("part").over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, 0))  # at most CELLS rows
    cut = sums.withColumn("upto", upto).where(F.col("upto") > rest).orderBy("cell").limit(1).first()
    rest, bound = rest - (cut["upto"] - cut["part"]), F.lit(cut["cell"])

    def entry(k: Column, p: Column) -> Column:
        """A row's place in the global order."""
        return F.struct(finish(k, p).alias("finish"), F.col("place"), p.cast("int").alias("pass"), F.col("shuffle"), k.cast("long").alias("k"))

    last_cell = line.where((F.col("low") <= bound) & (F.col("high") >= bound)).withColumns({"from": below(bound, p) + 1, "to": below(bound + 1, p)}).where(F.col("from") <= F.col("to"))
    entries = last_cell.withColumn("k", F.explode(F.sequence("from", "to"))).select(entry(F.col("k"), p).alias("e"), "size")
    used = F.sum("size").over(W.orderBy("e").rowsBetween(W.unboundedPreceding, 0))  # one in CELLS of one slot
    last = entries.withColumn("used", used).where(F.col("used") <= rest).agg(F.max("e").alias("e")).first()["e"]
    taken = [below(bound, F.lit(k)) for k in range(passes)]
    if last is None:
        return taken
    kinds = ("double", "long", "int", "string", "long")
    end = F.struct(*(F.lit(v).cast(kind).alias(name) for (name, v), kind in zip(last.asDict().items(), kinds, strict=True)))
    return [F.greatest(t, first(lambda k, q=F.lit(q): entry(k, q) <= end, rows_until(F.lit(last["finish"]), F.lit(q)))) for q, t in enumerate(taken)]


def copies_of(k: Column, passes: int) -> Column:
    """How often the mix holds the k-th row of a group."""
    return sum((F.when(k <= F.col(f"taken_{p}"), 1).otherwise(0) for p in range(passes)), F.lit(0)).cast("int")


def mix_plan(docs: DataFrame, *, passes: int = 2, **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken, shuffle) for every document; ``options`` are weights and share.

    ``copies`` says how often the mix holds the document, from 0 to ``passes``.
    """
    groups = written(grouped_plan(docs, passes=passes, **options), "mix-plan")
    single = groups.where("m = 1").withColumn("k", F.lit(1).cast("long"))
    starts = groups.where("m > 1").withColumn("first", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"), F.lit(STRETCH).cast("long"))))
    many = starts.repartition("shuffle", "first").withColumn("k", F.explode(F.sequence("first", F.least(F.col("first") + STRETCH - 1, F.col("m"))))).drop("first")
    rows = single.unionByName(many).withColumn("copies", copies_of(F.col("k"), passes))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "shuffle")


def mix(docs: DataFrame, *, passes: int = 2, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the plan takes it.

    Rows of a group are numbered inside the partitions that they lie in, and partitions after one another, so a group is never brought together.
    """
    found = grouped_plan(docs, passes=passes, **options)
    some = " + ".join(f"taken_{p}" for p in range(passes))
    place, name, m, part, k, copy, first = (free_name(docs, c) for c in ("plan_place", "plan_source", "plan_m", "plan_part", "plan_k", "plan_copy", "plan_first"))
    plan = written(found.where(f"{some} > 0").select(F.col("shuffle").alias(place), F.col("source").alias(name), F.col("m").alias(m), *(f"taken_{p}" for p in range(passes))), "mix-plan").alias("p")
    rows = docs.withColumn(place, shuffled()).alias("d")
    same = (F.col(f"d.{place}") == F.col(f"p.{place}")) & F.col("d.source").cast("string").eqNullSafe(F.col(f"p.{name}"))
    own = F.struct(*(F.col(f"d.`{c}`") for c in docs.columns)).alias("row")
    taken = rows.join(plan, same).select(own, F.col(f"p.{place}").alias(place), F.col(f"p.{name}").alias(name), F.col(f"p.{m}").alias(m), *(F.col(f"p.taken_{p}") for p in range(passes)))
    single = taken.where(F.col(m) == 1).withColumn(k, F.lit(1).cast("long"))
    many = written(taken.where(F.col(m) > 1).withColumn(part, F.spark_partition_id()), "mix-repeated")
    counts = many.groupBy(place, name, part).agg(F.count("*").alias("n"))
    earlier = W.partitionBy(place, name).orderBy(part).rowsBetween(W.unboundedPreceding, -1)  # a row for each partition
    counts = counts.select(F.col(place).alias("at"), F.col(name).alias("of"), F.col(part).alias("in"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(first)).alias("c")
    here = (F.col(place) == F.col("c.at")) & F.col(name).eqNullSafe(F.col("c.of")) & (F.col(part) == F.col("c.in"))
    number = F.row_number().over(W.partitionBy(place, name, part).orderBy(place))
    many = many.withColumn(k, number.cast("long")).join(counts, here).withColumn(k, F.col(k) + F.col(first)).select(single.columns)
    both = single.unionByName(many).withColumn(copy, copies_of(F.col(k), passes)).where(F.col(copy) > 0)
    return both.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy)))).select(*(F.col(f"row.`{c}`") for c in docs.columns))
