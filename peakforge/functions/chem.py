"""Formulas as column expressions: element counts, masses, order of elements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed monoisotopic masses in unified atomic mass units
MASSES = {"C": 12.0, "H": 1.00782503223, "N": 14.00307400443, "O": 15.99491461957, "S": 31.9720711744, "P": 30.97376199842, "Cl": 34.968852682, "Br": 78.9183376, "F": 18.99840316273, "Si": 27.97692653465, "I": 126.9044719, "Na": 22.989769282}
#: fixed electron mass in the same units
ELECTRON = 0.000548579909065
ELEMENT = r"([A-Z][a-z]?)([0-9]*)"


def element_counts(formula: Column) -> Column:
    """Map of element to count of a flat formula; repeated elements add up."""
    names, numbers = F.regexp_extract_all(formula, F.lit(ELEMENT), F.lit(1)), F.regexp_extract_all(formula, F.lit(ELEMENT), F.lit(2))
    pairs = F.zip_with(names, numbers, lambda e, n: F.struct(e.alias("e"), F.when(n == "", 1).otherwise(n.cast("int")).alias("n")))
    distinct = F.array_distinct(names)
    total = lambda e: F.aggregate(F.filter(pairs, lambda p: p["e"] == e), F.lit(0), lambda a, p: a + p["n"])
    return F.map_from_arrays(distinct, F.transform(distinct, total))


def monoisotopic_mass(counts: Column) -> Column:
    """Sum of count times mass; null for an element without a known mass."""
    table = F.create_map(*(x for k, v in MASSES.items() for x in (F.lit(k), F.lit(v))))
    return F.aggregate(F.map_entries(counts), F.lit(0.0), lambda a, e: a + e["value"] * F.element_at(table, e["key"]))


def hill_order(counts: Column) -> Column:
    """Formula text: carbon, hydrogen, then the rest by name; without carbon all by name; ones left out."""
    has_c = F.map_contains_key(counts, "C")
    key = lambda e: F.when(has_c & (e == "C"), F.lit("\x01")).when(has_c & (e == "H"), F.lit("\x02")).otherwise(e)
    entries = F.array_sort(F.transform(F.map_entries(counts), lambda e: F.struct(key(e["key"]).alias("o"), e["key"].alias("e"), e["value"].alias("n"))))
    parts = F.transform(F.filter(entries, lambda e: e["n"] > 0), lambda e: F.concat(e["e"], F.when(e["n"] > 1, e["n"].cast("string")).otherwise("")))
    return F.array_join(parts, "")


def unsaturation(counts: Column) -> Column:
    """Double-bond equivalents from counts of C, N, P, Si and monovalent elements."""
    n = lambda e: F.coalesce(F.element_at(counts, F.lit(e)), F.lit(0))
    return 1 + n("C") + n("Si") - (n("H") + n("F") + n("Cl") + n("Br") + n("I")) / 2 + (n("N") + n("P")) / 2


def ppm_error(observed: Column, target: Column) -> Column:
    return 1e6 * (observed - target) / target


def tof_to_mass(mode: Column, tof: Column, p: list[Column]) -> Column:
    """m/z of a flight time for the calibration modes that invert in closed form; null for any other.

    Mode 0: tof = p0 * sqrt(m) + p1; 1: p0 / sqrt(m) + p1; 2: p0 * m ** p2 + p1; 5: m = p0 * tof ** 2 + p1 * tof + p2.
    """
    return (
        F.when(mode == 0, F.pow((tof - p[1]) / p[0], 2))
        .when(mode == 1, F.pow(p[0] / (tof - p[1]), 2))
        .when(mode == 2, F.pow((tof - p[1]) / p[0], 1 / p[2]))
        .when(mode == 5, p[0] * tof * tof + p[1] * tof + p[2])
    )

