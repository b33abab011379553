"""License scans by an exact set-similarity join, in DataFrame operations only.

Text blocks are all runs of one to ``LINES`` lines that follow each other in a document, so that wrapped notices stand in one
block; templates are short license notices. A block matches a template if it holds at least ``threshold`` of the
template's distinct words, and all words that set the template apart from those of other labels that are as near (``telling``).
Words are ordered by the number of lines that hold them, the rarest first; a match then has to share one
of the template's first |T| - o + 1 words (o is the overlap needed), and a shared word that stands too late in either order
cannot be the first of o shared ones. What passes the prefix, length and positional filters is verified by
intersecting the sets, so the join finds every match and no other. Where a template's shared words are all shared by another
one that holds more of them, or a larger part of it, in the same block, the block is the other's: a line of the LGPL is no GPL.

The index of the templates' prefixes carries their words, so prefix, filters and verification are one stage
without a shuffle; only hits are shuffled. Only the templates' words of a block can count towards an overlap, so only
they are kept; their number of lines is counted over all lines of all documents. The templates are a parameter. The driver holds their words,
at most ``MAX_WORDS`` (more raise a ValueError), and their counts.

Beside the join, the base scan finds phrases as consecutive words. Lower-casing beyond A-Z changes no word's extent and
none of the phrases.

Defined cases: a null text is an empty one (no words, no labels, score 0); null and repeated ids are kept row by row;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakforge.llm.common import written

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
TEMPLATES = {
    "mit": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software"],
    "apache-2": ["licensed under the apache license version 2 0"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"],
    "cc-by": ["creative commons attribution 4 0 international license"],
    "cc-by-sa": ["creative commons attribution sharealike 4 0 international license"],
    "gpl-3": ["licensed under the gnu general public license version 3"],
    "gpl-2": ["licensed under the gnu general public license version 2"],
    "lgpl-3": ["licensed under the gnu lesser general public license version 3"],
    "agpl-3": ["licensed under the gnu affero general public license version 3"],
    "mpl-2": ["subject to the terms of the mozilla public license version 2 0"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted"],
}
MAX_WORDS = 10_000
LINES, MAX_PREFIXES = 6, 100_000
GAP = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"  # between words of a line


def words_of(text: str) -> list[str]:
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()) if w]


def telling(wanted: list[tuple[str, list[str]]], threshold: float) -> list[list[str]]:
    """For each (label, words): the words missing from any template of another label that holds ``threshold`` of them."""
    out = []
    for label, ws in wanted:
        near = [set(vs) for other, vs in wanted if other != label and len(set(ws) & set(vs)) >= math.ceil(threshold * len(ws))]
        out.append(sorted({w for vs in near for w in ws if w not in vs}))
    return out


def base_scan(norm: Column) -> dict[str, Column]:
    """n_base, first_word, last_word and base_labels of ``norm``: words with one space around each."""
    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        n = F.regexp_count(norm, F.lit(f"(?<= ){phrase}(?= )"))
        counts.append(n)
        found = n > 0
        firsts.append(F.when(found, spaces(F.substring_index(norm, f" {phrase} ", 1))))
        after = spaces(F.substring_index(norm, f" {phrase} ", -1))
        lasts.append(F.when(found, spaces(norm) - 1 - after - len(phrase.split())))
        labels.append(F.when(found, F.lit(label)))
    return {
        "n_base": sum(counts[1:], counts[0]).cast("long"),
        "first_word": F.least(*firsts).cast("long"),
        "last_word": F.greatest(*lasts).cast("long"),
        "base": F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))),
    }


def scan(docs: DataFrame, *, templates: dict[str, list[str]] | None = None, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base array, found array, score, matched array) for every row.

    ``matched`` has the labels of all templates of which some block holds ``threshold``: the result of the join; ``found`` those of them that
    the block tells from its neighbours by their own words and that no other match of the block takes in. ``score`` is 1 where a base phrase stands, else
    the largest share of a matching template that a block holds, else 0.
    """
    wanted = [(label, sorted(set(words_of(t)))) for label, texts in (templates or TEMPLATES).items() for t in texts]
    vocabulary = sorted({w for _, ws in wanted for w in ws})
    if len(vocabulary) > MAX_WORDS:
        raise ValueError(f"templates have more than {MAX_WORDS} distinct words")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.regexp_replace(F.lower(text), GAP, " ")
    held = F.array(*(F.lit(w) for w in vocabulary))
    blocks = F.transform(F.split(F.col("lines"), "\n"), lambda x: F.array_intersect(F.split(x, " "), held))
    likely = F.col("lines").rlike(r"mit[ \n]+license|apache[ \n]+license|cc[ \n]+by[ \n]+nc")
    norm = F.when(likely, F.concat(F.lit(" "), F.trim(F.regexp_replace("lines", "[ \n]+", " ")), F.lit(" "))).otherwise(F.lit(" "))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lines.alias("lines"))
    rows = rows.select("doc_id", F.regexp_count("lines", F.lit("[^ \n]+")).cast("long").alias("n_words"), norm.alias("norm"), blocks.alias("blocks"))
    rows = written(
        rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", *(v.alias(k) for k, v in base_scan(F.col("norm")).items()), "blocks"),
        "license-rows",
    )
    known = rows.select(F.explode(F.flatten("blocks")).alias("word")).groupBy("word").count()
    freq = {r["word"]: r["count"] for r in known.collect()}  # at most MAX_WORDS rows
    order = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (freq.get(w, 0), w)))}

    rank_of = F.create_map(*(x for w, k in order.items() for x in (F.lit(w), F.lit(k))))
    prefixes = []
    for tid, ((label, ws), must) in enumerate(zip(wanted, telling(wanted, threshold), strict=True)):
        ranks = sorted(order[w] for w in ws)
        need = math.ceil(threshold * len(ranks))
        prefixes += [(r, tid, label, i, ranks, [order[w] for w in must], need) for i, r in enumerate(ranks[: len(ranks) - need + 1])]
    if len(prefixes) > MAX_PREFIXES:
        raise ValueError(f"templates have more than {MAX_PREFIXES} prefix words")
    index = docs.sparkSession.createDataFrame(prefixes, "rank int, tid int, label string, i int, ranks array<int>, must array<int>, need int")

    least = min(p[6] for p in prefixes)
    opening = F.array(*(F.lit(r) for r in sorted({p[0] for p in prefixes})))
    lines = F.transform("blocks", lambda x: F.transform(x, lambda w: rank_of[w]))
    runs = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.size("b") - 1),
            lambda at: F.transform(
                F.sequence(F.lit(1), F.least(F.lit(LINES), F.size("b") - at)),
                lambda n: F.when((F.size(F.get("b", at)) > 0) & (F.size(F.get("b", at + n - 1)) > 0), F.array_sort(F.array_distinct(F.flatten(F.slice("b", at + 1, n))))),
            ),
        )
    )
    some = rows.where(F.size(F.flatten("blocks")) >= least).select("row", lines.alias("b"))
    each = some.select("row", F.posexplode(F.filter(runs, lambda x: x.isNotNull() & (F.size(x) >= least))).alias("nr", "block"))
    places = F.filter(F.transform("block", lambda r, j: F.struct(j.alias("j"), r.alias("rank"))), lambda x: F.array_contains(opening, x["rank"]))
    hits = each.select("row", "nr", "block", F.explode(places).alias("p")).select("row", "nr", "block", "p.j", "p.rank").join(F.broadcast(index), "rank")
    n, size = F.size("block"), F.size("ranks")
    hits = hits.where((n >= F.col("need")) & (1 + F.least(size - F.col("i") - 1, n - F.col("j") - 1) >= F.col("need")))
    hits = hits.withColumn("shared", F.array_intersect("block", "ranks"))
    hits = hits.where(F.size("shared") >= F.col("need"))
    share = (F.size("shared") / size).alias("share")
    told = (F.size(F.array_intersect("shared", "must")) == F.size("must")).alias("told")
    # as many structs a block as there are templates at most; a template's prefix words may each have found it
    every = hits.groupBy("row", "nr").agg(F.collect_set(F.struct("label", "shared", share, told)).alias("all"))
    matched = every.withColumn("m", F.filter("all", lambda x: x["told"]))

    def beaten(x: Column) -> Column:
        """Whether another match of the block takes the words of match ``x``."""
        sx = F.size(x["shared"])
        return F.exists(
            "m",
            lambda y: (F.size(F.array_except(x["shared"], y["shared"])) == 0)
            & ((F.size(y["shared"]) > sx) | ((F.size(y["shared"]) == sx) & (y["share"] > x["share"]))),
        )

    best = F.transform(F.filter("m", lambda x: ~beaten(x)), lambda x: F.struct(x["label"].alias("label"), x["share"].alias("share")))
    all_ = F.transform("all", lambda x: F.struct(x["label"].alias("label"), x["share"].alias("share")))
    kept = matched.select("row", F.explode(F.concat(F.transform(best, lambda x: F.struct(F.lit(True).alias("best"), x.alias("x"))), F.transform(all_, lambda x: F.struct(F.lit(False).alias("best"), x.alias("x"))))).alias("y"))
    kept = kept.select("row", "y.best", "y.x.label", "y.x.share")
    own = lambda c: F.when(F.col("best"), F.col(c))
    per_row = kept.groupBy("row").agg(F.array_sort(F.collect_set(own("label"))).alias("found"), F.max(own("share")).alias("share"), F.array_sort(F.collect_set("label")).alias("matched"))
    none = F.array().cast("array<string>")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0)))
    return rows.drop("blocks").join(per_row, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base", F.coalesce("found", none).alias("found"), score.alias("score"), F.coalesce("matched", none).alias("matched")
    )
