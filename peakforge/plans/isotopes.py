"""Queries on isotopologues: of all elements of a formula, of known formulas as ions, at high and at low resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from peakforge.functions import chem
from peakforge.operators import signal
from peakforge.operators.isotopes import HEAVY_SLOTS, ISOTOPES, ionized, isotopologues
from peakforge.plans.registry import query
from peakforge.sources.fixtures import MECHANISMS, Tables

#: formulas with every element of several isotopes, derived from parts; one definition for both engines
MIXED = {"C": "1 + p_partkey % 37", "H": "2 + p_partkey % 61", "N": "p_size % 4", "O": "1 + p_size % 6", "S": "p_partkey % 3", "Cl": "p_size % 3", "Br": "p_partkey % 2", "Si": "p_size % 2"}
HIGH, SEARCH = 1e-5, 1e-2


def sql_isotopologues(source: str, elements: list[str], floor: float, keys: str) -> str:
    """CTEs that end in ``iso`` (keys, label, shift, share, rel), for ``source`` with a column of counts for each element, n_<element>."""
    heavy = "iso_table(element, slot, a, step, p) AS (VALUES " + ", ".join(
        f"('{e}', {j}, {a}, {m!r}e0 - {ISOTOPES[e][0][1]!r}e0, {p!r}e0)" for e in elements if e in ISOTOPES for j, (a, m, p) in enumerate(ISOTOPES[e])
    ) + ")"
    numbers = "numbers AS (" + " UNION ".join(f"SELECT '{e}' AS element, n_{e} AS n FROM {source} WHERE n_{e} > 0" for e in elements) + ")"
    slots = range(1, HEAVY_SLOTS + 1)
    more = " ".join(f"LEFT JOIN iso_table t{j} ON t{j}.element = numbers.element AND t{j}.slot = {j}" for j in slots)
    ks = ", ".join(f"range(CASE WHEN t{j}.a IS NULL THEN 1 ELSE n + 1 END) r{j}(k{j})" for j in slots)
    total = " + ".join(f"k{j}" for j in slots)
    label = " || ".join(f"CASE WHEN k{j} = 0 THEN '' ELSE '[' || t{j}.a || numbers.element || ']' || CASE WHEN k{j} > 1 THEN k{j}::VARCHAR ELSE '' END END" for j in slots)
    shift = " + ".join(f"k{j} * coalesce(t{j}.step, 0e0)" for j in slots)
    log = f"lgamma(n + 1) - lgamma(n - ({total}) + 1)" + "".join(f" - lgamma(k{j} + 1)" for j in slots)
    power = f"pow(coalesce(t0.p, 1e0), n - ({total}))" + "".join(f" * CASE WHEN k{j} = 0 THEN 1e0 ELSE pow(t{j}.p, k{j}) END" for j in slots)
    split = f"""split AS (SELECT * FROM (SELECT *, share / max(share) OVER (PARTITION BY element, n) AS rel FROM (
        SELECT numbers.element, n, {label} AS label, {shift} AS shift, exp({log}) * {power} AS share FROM numbers LEFT JOIN iso_table t0 ON t0.element = numbers.element AND t0.slot = 0 {more}, {ks} WHERE {total} <= n)) WHERE rel >= {floor!r}e0)"""
    steps, last = [], "grown0"
    carried = ", ".join(f"n_{e}" for e in elements)
    steps.append(f"grown0 AS (SELECT {keys}, {carried}, '' AS label, 0e0 AS shift, 1e0 AS share, 1e0 AS rel FROM {source})")
    for i, e in enumerate(sorted(elements), 1):
        steps.append(
            f"grown{i} AS (SELECT {keys}, {carried}, g.label || coalesce(s.label, '') AS label, g.shift + coalesce(s.shift, 0e0) AS shift, g.share * coalesce(s.share, 1e0) AS share, g.rel * coalesce(s.rel, 1e0) AS rel "
            f"FROM {last} g LEFT JOIN split s ON s.element = '{e}' AND s.n = g.n_{e} WHERE g.rel * coalesce(s.rel, 1e0) >= {floor!r}e0)"
        )
        last = f"grown{i}"
    return ",\n".join([heavy.replace("e0e0", "e0"), numbers, split, *steps, f"iso AS (SELECT {keys}, label, shift, share, rel FROM {last})"]).replace("e-05e0", "e-5")


MIXED_SQL = "mixed AS (SELECT p_partkey AS id, " + ", ".join(f"CAST({v} AS INT) AS n_{e}" for e, v in MIXED.items()) + " FROM part)"


@query("expand_isotopologues", f"WITH {MIXED_SQL}, {sql_isotopologues('mixed', list(MIXED), HIGH, 'id')} SELECT id, label, round(shift, 6) AS shift, round(share, 9) AS abundance FROM iso")
def _(t: Tables):
    """Every isotopologue of formulas of C, H, N, O, S, Cl, Br and Si above 1e-5 of the most abundant one."""
    counts = F.map_from_arrays(F.array(*map(F.lit, MIXED)), F.array(*(F.expr(f"CAST({v} AS INT)") for v in MIXED.values())))
    rows = isotopologues(t.raw("part").select(F.col("p_partkey").alias("id"), counts.alias("counts")), floor=HIGH)
    return rows.select("id", "label", F.round("shift", 6).alias("shift"), F.round("abundance", 9).alias("abundance"))


def known_isotopes(t: Tables):
    """(formula, mechanism, label, mz, share) of the library's formulas as ions of each mechanism, isotopes above 1 % of the strongest."""
    f = t.isotopes.select("formula").distinct().withColumn("counts", chem.element_counts(F.col("formula")))
    ions = ionized(f, t.mechanisms).withColumn("mass", (chem.monoisotopic_mass(F.col("counts")) - F.col("charge") * chem.ELECTRON) / F.abs("charge"))
    rows = isotopologues(ions, floor=SEARCH)
    return rows.select("formula", "mechanism", "label", (F.col("mass") + F.col("shift") / F.abs("charge")).alias("mz"), F.col("relative").alias("share"))


def _known_sql() -> str:
    own = {e: f"coalesce(CAST(nullif(regexp_extract(formula, '{e}([0-9]+)', 1), '') AS INT), 0)" for e in ("C", "H", "O")}
    used = ["C", "H", "O", "N", "Na", "Cl", "Br"]
    added = {"H": {"H": 1}, "Na": {"Na": 1}, "NH4": {"N": 1, "H": 4}, "Cl": {"Cl": 1}, "Br": {"Br": 1}}
    ways = ", ".join(f"('{m}', {z}, " + ", ".join(str((-1 if m.startswith("-") else 1) * added[b].get(e, 0)) for e in used) + ")" for m, b, z in MECHANISMS)
    counts = ", ".join(f"{own.get(e, '0')} + d_{e} AS n_{e}" for e in used)
    mass = " + ".join(f"{chem.MASSES[e]!r}e0 * n_{e}" for e in used)
    return f"""ways(mechanism, charge, {", ".join("d_" + e for e in used)}) AS (VALUES {ways}),
    ions AS (SELECT * FROM (SELECT formula, mechanism, charge, {counts} FROM (SELECT DISTINCT formula FROM isotopes), ways) WHERE least({", ".join("n_" + e for e in used)}) >= 0),
    {sql_isotopologues("ions", used, SEARCH, "formula, mechanism")},
    known AS (SELECT i.formula, i.mechanism, label, {mass} - charge * 0.000548579909065e0 + shift AS mz, rel AS share FROM iso i JOIN ions USING (formula, mechanism))"""


KNOWN_SQL = _known_sql()


@query("reference_isotopes", f"WITH {KNOWN_SQL} SELECT formula, mechanism, label, round(mz, 6) AS mz, round(share, 6) AS abundance, round(mz / (1.2e5 / sqrt(mz)), 8) AS fwhm FROM known", "isotopes")
def _(t: Tables):
    """Known formulas become ions of each mechanism, ions become isotopes above the floor, each with the width that the instrument has there."""
    fwhm = F.col("mz") / (1.2e5 / F.sqrt("mz"))
    return known_isotopes(t).select("formula", "mechanism", "label", F.round("mz", 6).alias("mz"), F.round("share", 6).alias("abundance"), F.round(fwhm, 8).alias("fwhm"))


@query(
    "group_low_resolution",
    f"""WITH {KNOWN_SQL}, g AS (SELECT *, sum(fresh) OVER (PARTITION BY formula, mechanism ORDER BY mz, label ROWS UNBOUNDED PRECEDING) AS bin FROM (SELECT *, CASE WHEN (mz - lag(mz) OVER w) / lag(mz) OVER w * 1e6 > 5e1 THEN 1 ELSE 0 END AS fresh
    FROM known WINDOW w AS (PARTITION BY formula, mechanism ORDER BY mz, label)))
    SELECT formula, mechanism, round(sum(mz * share) / sum(share), 6) AS mz, round(sum(share), 6) AS abundance, string_agg(label, '+' ORDER BY label) AS parts FROM g GROUP BY formula, mechanism, bin""",
    "isotopes",
)
def _(t: Tables):
    """Isotopes that an instrument of resolution 10,000 sees as one: within half a width (50 ppm) of the first of a group."""
    named = known_isotopes(t).select("formula", "mechanism", "mz", F.col("label").alias("peak_id"), F.col("share").alias("intensity"))
    c = signal.window_cluster(named, ppm=50.0, keys=("formula", "mechanism")).groupBy("formula", "mechanism", "cluster")
    mz = F.sum(F.col("mz") * F.col("intensity")) / F.sum("intensity")
    rows = c.agg(F.round(mz, 6).alias("mz"), F.round(F.sum("intensity"), 6).alias("abundance"), F.array_join(F.array_sort(F.collect_list("peak_id")), "+").alias("parts"))
    return rows.drop("cluster")
