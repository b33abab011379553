"""Isotopologues of formulas: splits of each element's atoms into isotopes, joined element after element under a floor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakforge.functions.chem import MASSES

#: fixed isotopes of elements: mass number, mass in unified atomic mass units, natural share; the lightest first
ISOTOPES = {
    "H": [(1, 1.00782503223, 0.999885), (2, 2.01410177812, 0.000115)],
    "C": [(12, 12.0, 0.9893), (13, 13.00335483507, 0.0107)],
    "N": [(14, 14.00307400443, 0.99636), (15, 15.00010889888, 0.00364)],
    "O": [(16, 15.99491461957, 0.99757), (17, 16.9991317565, 0.00038), (18, 17.99915961286, 0.00205)],
    "Si": [(28, 27.97692653465, 0.92223), (29, 28.9764946649, 0.04685), (30, 29.973770136, 0.03092)],
    "S": [(32, 31.9720711744, 0.9499), (33, 32.9714589098, 0.0075), (34, 33.967867004, 0.0425), (36, 35.96708071, 0.0001)],
    "Cl": [(35, 34.968852682, 0.7576), (37, 36.965902602, 0.2424)],
    "Br": [(79, 78.9183376, 0.5069), (81, 80.9162897, 0.4931)],
}
HEAVY_SLOTS = max(len(v) for v in ISOTOPES.values()) - 1


def ways(n: Column, k: Column) -> Column:
    """Binomial coefficient as a double."""
    return F.aggregate(F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>")), F.lit(1.0), lambda a, i: a * (n - k + i) / i)


def splits(counts: DataFrame, floor: float) -> DataFrame:
    """(element, n, label, shift, share, rel) for (element, n): every split of n atoms of an element into its isotopes.

    ``shift`` is the mass above that of the lightest isotopes, ``share`` the multinomial probability, ``rel`` that share over the largest
    one of the element's splits; splits below ``floor`` of the largest are left out, as nothing can make up for them. Elements of one isotope have one split.
    """
    known = F.create_map(*(x for e, isotopes in ISOTOPES.items() for x in (F.lit(e), F.array(*(F.struct(F.lit(a).alias("a"), F.lit(m).alias("m"), F.lit(p).alias("p")) for a, m, p in isotopes)))))
    rows = counts.withColumn("iso", F.element_at(known, F.col("element"))).withColumn("left", F.col("n").cast("int"))
    share, shift, label = F.lit(1.0), F.lit(0.0), []
    for j in range(1, HEAVY_SLOTS + 1):
        here, k = F.get("iso", F.lit(j)), F.col(f"k{j}")
        rows = rows.withColumn(f"k{j}", F.explode(F.sequence(F.lit(0), F.when(here.isNotNull(), F.col("left")).otherwise(0))))
        rows = rows.withColumn(f"w{j}", F.when(k > 0, ways(F.col("left"), k) * F.pow(here["p"], k)).otherwise(1.0)).withColumn("left", F.col("left") - k)
        share = share * F.col(f"w{j}")
        shift = shift + F.when(k > 0, k * (here["m"] - F.get("iso", F.lit(0))["m"])).otherwise(0.0)
        label.append(F.when(k > 0, F.concat(F.lit("["), here["a"].cast("string"), F.col("element"), F.lit("]"), F.when(k > 1, k.cast("string")).otherwise(""))).otherwise(""))
    light = F.coalesce(F.pow(F.get("iso", F.lit(0))["p"], F.col("left")), F.lit(1.0))
    rows = rows.select("element", "n", F.concat(*label).alias("label"), shift.alias("shift"), (share * light).alias("share"))
    top = rows.groupBy("element", "n").agg(F.max("share").alias("top"))
    return rows.join(top, ["element", "n"]).withColumn("rel", F.col("share") / F.col("top")).where(F.col("rel") >= floor).drop("top")


def isotopologues(ions: DataFrame, *, floor: float, counts: str = "counts") -> DataFrame:
    """The columns of ``ions`` with label, shift and abundance of each isotopologue of at least ``floor`` of the most abundant one.

    ``counts`` is a map of element to number. Elements are independent, so the share of an isotopologue over the largest is the product of its splits'; a partial
    product below the floor is dropped at once, which loses nothing. Rows with an element of unknown mass are left out. Equal counts are expanded once, and of an
    element only its number is exchanged, until the few numbers of atoms that occur have their splits.
    """
    keys = [c for c in ions.columns if c != counts]
    entries = F.filter(F.map_entries(counts), lambda e: e["value"] > 0)
    told = F.array_sort(F.transform(entries, lambda e: F.struct(e["key"].alias("element"), e["value"].cast("int").alias("n"))))
    known = ions.where(F.forall(entries, lambda e: e["key"].isin(*MASSES))).select(*keys, told.alias("_formula"))
    formulas = known.select("_formula").distinct()
    parts = formulas.select("_formula", F.explode("_formula").alias("e")).select("_formula", "e.*")
    table = splits(parts.select("element", "n").distinct(), floor)
    options = table.groupBy("element", "n").agg(F.collect_list(F.struct("label", "shift", "share", "rel")).alias("options"))  # the splits of one element, above the floor
    n = int(ions.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes make many rows: as many tasks as there may be, not as few as the bytes fill
    joined = parts.join(options, ["element", "n"]).repartition(n, "_formula").groupBy("_formula").agg(F.array_sort(F.collect_list(F.struct("element", "options"))).alias("parts"))
    start = F.array(F.struct(F.lit("").alias("label"), F.lit(0.0).alias("shift"), F.lit(1.0).alias("share"), F.lit(1.0).alias("rel")))

    def both(a: Column, s: Column) -> Column:
        return F.struct(F.concat(a["label"], s["label"]).alias("label"), (a["shift"] + s["shift"]).alias("shift"), (a["share"] * s["share"]).alias("share"), (a["rel"] * s["rel"]).alias("rel"))

    def grown(acc: Column, part: Column) -> Column:
        return F.flatten(F.transform(acc, lambda a: F.filter(F.transform(part["options"], lambda s: both(a, s)), lambda x: x["rel"] >= floor)))

    grown_up = joined.select("_formula", F.aggregate("parts", start, grown).alias("all"))
    found = known.join(grown_up, "_formula").select(*keys, F.explode("all").alias("i"))
    return found.select(*keys, "i.label", "i.shift", F.col("i.share").alias("abundance"), F.col("i.rel").alias("relative"))


def ionized(formulas: DataFrame, mechanisms: DataFrame) -> DataFrame:
    """(formula, mechanism, charge, counts) of each formula under each mechanism that leaves no element short.

    ``formulas`` holds (formula, counts), ``mechanisms`` (mechanism, addition, added, charge); the few mechanisms go to every formula as one array.
    """
    listed = mechanisms.agg(F.collect_list(F.struct("mechanism", "addition", "added", "charge")).alias("all"))  # a row for each mechanism of the table
    rows = formulas.crossJoin(F.broadcast(listed)).select("formula", "counts", F.explode("all").alias("m"))
    sign = F.when(F.col("m.addition"), 1).otherwise(-1)
    made = F.map_zip_with("counts", F.col("m.added"), lambda k, a, b: F.coalesce(a, F.lit(0)) + sign * F.coalesce(b, F.lit(0)))
    rows = rows.select("formula", F.col("m.mechanism").alias("mechanism"), F.col("m.charge").alias("charge"), made.alias("counts"))
    return rows.where(F.forall(F.map_values("counts"), lambda n: n >= 0))
