"""Queries on formulas and reference compounds."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from peakforge.functions import chem
from peakforge.operators import scan
from peakforge.plans.registry import query
from peakforge.sources.fixtures import Tables

COUNT = "CAST(coalesce(nullif(regexp_extract(formula, '{e}([0-9]+)', 1), ''), '0') AS INT)"
C, H, O = (COUNT.format(e=e) for e in "CHO")
COMPOUNDS = "f AS (SELECT DISTINCT formula FROM isotopes)"


def formulas(t: Tables):
    """Distinct formulas: work on text is done once for each."""
    return t.isotopes.select("formula").distinct().withColumn("counts", chem.element_counts(F.col("formula")))


@query("element_counts", f"WITH {COMPOUNDS} SELECT formula, {C} AS c, {H} AS h, {O} AS o FROM f", "isotopes")
def _(t: Tables):
    return formulas(t).select("formula", F.col("counts")["C"].alias("c"), F.col("counts")["H"].alias("h"), F.col("counts")["O"].alias("o"))


@query("monoisotopic_mass", f"WITH {COMPOUNDS} SELECT formula, round(12e0 * {C} + 1.00782503223e0 * {H} + 15.99491461957e0 * {O}, 6) AS mass FROM f", "isotopes")
def _(t: Tables):
    return formulas(t).select("formula", F.round(chem.monoisotopic_mass(F.col("counts")), 6).alias("mass"))


@query("canonical_formula", f"WITH {COMPOUNDS} SELECT formula, regexp_replace(regexp_replace(regexp_replace(formula, '^C1H', 'CH'), 'H1O', 'HO'), 'O1$', 'O') AS canonical FROM f", "isotopes")
def _(t: Tables):
    return formulas(t).select("formula", chem.hill_order(F.col("counts")).alias("canonical"))


@query("remove_ones", f"WITH {COMPOUNDS} SELECT formula, regexp_replace(formula, '([A-Z][a-z]?)1([A-Z]|$)', '\\1\\2', 'g') AS short FROM f", "isotopes")
def _(t: Tables):
    return t.isotopes.select("formula").distinct().select("formula", F.regexp_replace("formula", "([A-Z][a-z]?)1(?![0-9])", "$1").alias("short"))


@query("unsaturation", f"WITH {COMPOUNDS} SELECT formula, 1 + {C} - {H} / 2e0 AS dbe FROM f", "isotopes")
def _(t: Tables):
    return formulas(t).select("formula", chem.unsaturation(F.col("counts")).cast("double").alias("dbe"))


@query("sort_by_formula", f"WITH {COMPOUNDS} SELECT formula, row_number() OVER (ORDER BY {C}, {H}, {O}) AS position FROM f", "isotopes")
def _(t: Tables):
    n = F.col("counts")
    place = {"keys": (), "order": ("c", "h", "o", "formula")}
    rows = scan.ranged(formulas(t).select("formula", *(n[e].alias(e.lower()) for e in "CHO")), **place)
    return scan.running(rows, {"position": F.lit(1)}, **place).select("formula", "position")


@query("fit_native_id", "SELECT p_partkey AS id, CASE WHEN length(p_name) > 8 THEN substr(p_name, 1, 4) || substr(sha1(p_name), 1, 4) ELSE p_name END AS native_id FROM part")
def _(t: Tables):
    n = F.col("p_name")
    short = F.when(F.length(n) > 8, F.concat(F.substring(n, 1, 4), F.substring(F.sha1(n), 1, 4))).otherwise(n)
    return t.raw("part").select(F.col("p_partkey").alias("id"), short.alias("native_id"))


@query("norm_name", "SELECT c_custkey AS id, lower(trim(c_name)) AS name FROM customer")
def _(t: Tables):
    return t.raw("customer").select(F.col("c_custkey").alias("id"), F.lower(F.trim("c_name")).alias("name"))


@query("known_compositions", "SELECT formula, string_agg(name, '|' ORDER BY name) AS names FROM (SELECT formula, name, row_number() OVER (PARTITION BY formula ORDER BY name) AS n FROM (SELECT DISTINCT formula, compound_name AS name FROM isotopes)) WHERE n <= 25 GROUP BY formula", "isotopes")
def _(t: Tables):
    names = t.isotopes.select("formula", F.col("compound_name").alias("name")).distinct()
    top = names.withColumn("n", F.row_number().over(W.partitionBy("formula").orderBy("name"))).where("n <= 25")
    return top.groupBy("formula").agg(F.array_join(F.array_sort(F.collect_list("name")), "|").alias("names"))


@query(
    "build_ions",
    f"WITH {COMPOUNDS} SELECT formula, m AS mechanism, {H} + d AS h, round(12e0 * {C} + 1.00782503223e0 * ({H} + d) + 15.99491461957e0 * {O} - z * 0.000548579909065e0, 6) AS mz FROM f, (VALUES ('+H+', 1, 1), ('-H+', -1, -1)) v(m, d, z) WHERE {H} + d >= 0",
    "isotopes",
)
def _(t: Tables):
    ways = F.array(*(F.struct(F.lit(m).alias("m"), F.lit(d).alias("d"), F.lit(z).alias("z")) for m, d, z in (("+H+", 1, 1), ("-H+", -1, -1))))
    rows = formulas(t).withColumn("w", F.explode(ways)).withColumn("h", F.col("counts")["H"] + F.col("w.d")).where("h >= 0")
    mass = chem.monoisotopic_mass(F.col("counts")) + F.col("w.d") * chem.MASSES["H"] - F.col("w.z") * chem.ELECTRON
    return rows.select("formula", F.col("w.m").alias("mechanism"), "h", F.round(mass, 6).alias("mz"))


@query("mass_bounds", "SELECT isotope_id, round(mz - mz * 1e-5, 8) AS low, round(mz + mz * 1e-5, 8) AS high FROM isotopes", "isotopes")
def _(t: Tables):
    half = F.col("mz") * 1e-5
    return t.isotopes.select("isotope_id", F.round(F.col("mz") - half, 8).alias("low"), F.round(F.col("mz") + half, 8).alias("high"))


@query("ppm_error", "SELECT sid, isotope_id, round(1e6 * (mz - target_mz) / target_mz, 6) AS ppm FROM nearest", "nearest")
def _(t: Tables):
    return t.nearest.select("sid", "isotope_id", F.round(chem.ppm_error(F.col("mz"), F.col("target_mz")), 6).alias("ppm"))


@query("ion_formula_path", "SELECT DISTINCT formula || '/' || CAST(mechanism AS VARCHAR) AS path FROM isotopes", "isotopes")
def _(t: Tables):
    return t.isotopes.select(F.concat("formula", F.lit("/"), F.col("mechanism").cast("string")).alias("path")).distinct()


@query(
    "mz_calibrate_tof",
    """SELECT sid, round(regr_slope(2e0 * sqrt(peak_mz) + 3e0, sqrt(target_mz)), 6) AS p0, round(regr_intercept(2e0 * sqrt(peak_mz) + 3e0, sqrt(target_mz)), 5) AS p1, count(*) AS n
    FROM matches WHERE sid % 2 = 1 AND found AND collection_type = 'CALIBRANTS' AND abs(mz_error) <= 15 GROUP BY sid""",
    "matches",
)
def _(t: Tables):
    """Flight times of the calibrants of time-of-flight samples (2 * sqrt(m/z) + 3 here) on the root of their true masses."""
    good = t.matches_of("collection_type = 'CALIBRANTS'").where("sid % 2 = 1 AND found AND abs(mz_error) <= 15")
    y, x = 2 * F.sqrt("peak_mz") + 3, F.sqrt("target_mz")
    return good.groupBy("sid").agg(F.round(F.regr_slope(y, x), 6).alias("p0"), F.round(F.regr_intercept(y, x), 5).alias("p1"), F.count("*").alias("n"))
