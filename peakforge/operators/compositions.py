"""Search of elemental compositions within a mass tolerance, for any ranges of elements: meeting in the middle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from peakforge.functions.chem import ELECTRON, MASSES, hill_order, monoisotopic_mass
from peakforge.operators.joins import range_join

#: fixed contributions of an atom to twice the number of rings and double bonds
BONDS = {"C": 2, "Si": 2, "N": 1, "P": 1, "O": 0, "S": 0, "H": -1, "F": -1, "Cl": -1, "Br": -1, "I": -1, "Na": -1}


def halves(ranges: dict[str, tuple[int, int]]) -> tuple[list[str], list[str]]:
    """Elements in two groups: the two of the widest ranges, and the others, heaviest first."""
    wide = sorted(ranges, key=lambda e: (ranges[e][0] - ranges[e][1], e))[:2]
    order = sorted(ranges, key=lambda e: -MASSES[e])
    return [e for e in order if e in wide], [e for e in order if e not in wide]


def half_compositions(spark: SparkSession, elements: list[str], ranges: dict[str, tuple[int, int]], most: float) -> DataFrame:
    """(mass, bonds, counts) of all counts of ``elements`` within ``ranges`` that weigh at most ``most``: element by element, within what mass is left."""
    rows = spark.range(1).select(F.lit(0.0).alias("mass"), F.lit(0).alias("bonds"), *(F.lit(0).alias(f"n_{e}") for e in elements))
    for e in elements:
        low, high = ranges[e]
        top = F.least(F.lit(high), F.floor((F.lit(most) - F.col("mass")) / MASSES[e] + 1e-9).cast("int"))
        rows = rows.withColumn(f"n_{e}", F.explode(F.when(top >= low, F.sequence(F.lit(low), top)).otherwise(F.array().cast("array<int>"))))
        rows = rows.withColumns({"mass": F.col("mass") + MASSES[e] * F.col(f"n_{e}"), "bonds": F.col("bonds") + BONDS[e] * F.col(f"n_{e}")})
    counts = F.map_from_arrays(F.array(*map(F.lit, elements)).cast("array<string>"), F.array(*(F.col(f"n_{e}") for e in elements)).cast("array<int>"))
    return rows.select("mass", "bonds", counts.alias("counts"))


def search(
    peaks: DataFrame, ranges: DataFrame, mechanisms: DataFrame, *, ppm: float = 1.0, unsaturation: tuple[float, float] = (0.0, 50.0), whole: bool = False, most: int = 100, salts: int = 8
) -> DataFrame:
    """(id, mz, mechanism, formula, counts, neutral_mass, unsaturation, ppm, place) of the compositions that explain each peak.

    ``peaks`` holds (id, mz), ``ranges`` (element, low, high), ``mechanisms`` (mechanism, addition, added, charge) as in ``isotopes.ionized``. The neutral mass of a peak under
    a mechanism meets the half-compositions of the rarer elements that weigh no more, and what mass is left meets those of the other two elements
    by a range join; so rows grow with the half that fits and with the solutions, never with the box of all counts. ``unsaturation`` bounds rings and double bonds, ``whole`` asks
    for whole numbers of them; the ``most`` nearest compositions of a peak and mechanism stay, ties by formula. A mechanism that explains a peak alone gives the formula ``()``. Peaks of no
    positive neutral mass have no row; elements of unknown mass are refused.
    """
    spark = peaks.sparkSession
    box = {r["element"]: (r["low"], r["high"]) for r in ranges.select("element", "low", "high").collect()}  # a row for each element
    if unknown := sorted(set(box) - set(BONDS)):
        raise ValueError(f"no mass or valence is known for {', '.join(unknown)}")
    listed = mechanisms.agg(F.collect_list(F.struct("mechanism", "addition", "added", "charge")).alias("all"))
    asked = peaks.select("id", "mz").crossJoin(F.broadcast(listed)).select("id", "mz", F.explode("all").alias("m"))  # one row of few mechanisms
    body = monoisotopic_mass(F.col("m.added"))
    shift = F.when(F.col("m.addition"), body).otherwise(-body) - ELECTRON * F.col("m.charge")
    asked = asked.select("id", "mz", F.col("m.mechanism").alias("mechanism"), (F.col("mz") - shift).alias("neutral"), (F.col("mz") * (ppm * 1e-6)).alias("tolerance"))
    alone = asked.where(F.abs("neutral") <= F.col("tolerance"))
    alone = alone.select("id", "mz", "mechanism", F.lit("()").alias("formula"), F.lit(None).cast("map<string,int>").alias("counts"), F.lit(0.0).alias("neutral_mass"), F.lit(None).cast("double").alias("unsaturation"), (F.abs("neutral") / F.col("mz") * 1e6).alias("ppm"))
    asked = asked.where(F.col("neutral") > F.col("tolerance"))
    heaviest = asked.agg(F.max(F.col("neutral") + F.col("tolerance"))).first()[0]
    if heaviest is None:
        return placed(alone, most)
    light, rare = halves(box)
    first = half_compositions(spark, rare, box, heaviest).toDF("mass_a", "bonds_a", "counts_a")
    second = half_compositions(spark, light, box, heaviest).toDF("mass_b", "bonds_b", "counts_b")
    most_b = F.lit(sum(MASSES[e] * box[e][1] for e in light))  # what the other half can weigh at most
    begun = range_join(first, asked, low=F.col("neutral") - F.col("tolerance") - most_b, high=F.col("neutral") + F.col("tolerance"), width=100.0, point="mass_a", salts=salts)
    rest = F.col("neutral") - F.col("mass_a")
    begun = begun.withColumn("rest", rest).where(F.col("rest") >= -F.col("tolerance"))
    found = range_join(second, begun, low=F.col("rest") - F.col("tolerance"), high=F.col("rest") + F.col("tolerance"), width=0.05, point="mass_b")
    mass, bonds = F.col("mass_a") + F.col("mass_b"), F.col("bonds_a") + F.col("bonds_b")
    rings = 1 + bonds / 2
    found = found.where((F.abs(F.col("neutral") - mass) <= F.col("tolerance")) & rings.between(*unsaturation))
    if whole:
        found = found.where(bonds % 2 == 0)
    counts = F.map_filter(F.map_concat("counts_a", "counts_b"), lambda e, n: n > 0)
    found = found.select("id", "mz", "mechanism", hill_order(counts).alias("formula"), counts.alias("counts"), mass.alias("neutral_mass"), rings.cast("double").alias("unsaturation"), (F.abs(F.col("neutral") - mass) / F.col("mz") * 1e6).alias("ppm"))
    return placed(found.unionByName(alone), most)


def placed(found: DataFrame, most: int) -> DataFrame:
    w = W.partitionBy("id", "mechanism").orderBy("ppm", "formula")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
