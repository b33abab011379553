"""Queries that search compositions for peaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from peakforge.functions import chem
from peakforge.operators.compositions import BONDS, search
from peakforge.plans.registry import query
from peakforge.sources.fixtures import MECHANISMS, Tables

#: ranges of ten elements, as the search takes them in text
RANGES = "C0-60 H0-120 N0-2 O0-8 S0-1 Cl0-2 Br0-1 P0-1 Si0-1 F0-1"
WAYS = ("+H+", "+Br-")
PPM, MOST = 1.0, 100


def _ranges() -> list[tuple[str, int, int]]:
    import re

    return [(e, int(a), int(b)) for e, a, b in re.findall(r"([A-Z][a-z]?)([0-9]+)-([0-9]+)", RANGES)]


def _sql() -> str:
    rare = [(e, b) for e, _, b in _ranges() if e not in ("C", "H")]
    boxes = ", ".join(f"range({b + 1}) r_{e}(n_{e})" for e, b in rare)
    mass = " + ".join(f"{chem.MASSES[e]!r}e0 * n_{e}" for e, _ in rare)
    bonds = " + ".join(f"{BONDS[e]} * n_{e}" for e, _ in rare)
    added = {m: (chem.MASSES[b], z) for m, b, z in MECHANISMS if m in WAYS}
    ways = ", ".join(f"('{m}', {added[m][0]!r}e0 - {added[m][1]} * 0.000548579909065e0)" for m in WAYS)
    part = lambda e: f"CASE n_{e} WHEN 0 THEN '' WHEN 1 THEN '{e}' ELSE '{e}' || n_{e} END"
    others = sorted(e for e, _ in rare)
    # without carbon, hydrogen stands in the order of names
    plain = " || ".join(part(e) for e in sorted([*others, "H"]))
    hill = f"CASE WHEN n_C > 0 THEN {part('C')} || {part('H')} || {' || '.join(map(part, others))} ELSE {plain} END"
    return f"""WITH asked AS (SELECT ion_id, mechanism, mz, mz - shift AS neutral, mz * 1e0 * 1e-6 AS tol FROM (SELECT DISTINCT ion_id, mz FROM isotopes WHERE k = 0), (VALUES {ways}) w(mechanism, shift)),
    a AS (SELECT {mass} AS mass, {bonds} AS bonds, {", ".join("n_" + e for e, _ in rare)} FROM {boxes}),
    x AS (SELECT * FROM asked JOIN a ON a.mass <= neutral + tol WHERE neutral > tol),
    c AS (SELECT *, unnest(range(CAST(greatest(0, ceil((neutral - mass - 1.00782503223e0 * (bonds + 2) - tol) / (12e0 + 2 * 1.00782503223e0))) AS INT), CAST(least(60, floor((neutral - mass + tol) / 12e0)) AS INT) + 1)) AS n_C FROM x),
    h AS (SELECT *, CAST(round((neutral - mass - 12e0 * n_C) / 1.00782503223e0) AS INT) AS n_H FROM c),
    f AS (SELECT *, abs(neutral - (mass + (12e0 * n_C + 1.00782503223e0 * n_H))) / mz * 1e6 AS ppm, 1 + (bonds + 2 * n_C - n_H) / 2e0 AS rings FROM h
      WHERE n_H BETWEEN 0 AND 120 AND abs(neutral - (mass + (12e0 * n_C + 1.00782503223e0 * n_H))) <= tol),
    g AS (SELECT ion_id, mechanism, {hill} AS formula, rings, ppm FROM f WHERE rings BETWEEN 0 AND 50
      UNION ALL SELECT ion_id, mechanism, '()', NULL, abs(neutral) / mz * 1e6 FROM asked WHERE abs(neutral) <= tol)
    SELECT ion_id, mechanism, formula, rings AS unsaturation, round(ppm, 3) AS ppm, row_number() OVER (PARTITION BY ion_id, mechanism ORDER BY ppm, formula) AS place FROM g
    QUALIFY place <= {MOST}"""


@query("enumerate_compositions", _sql(), "isotopes")
def _(t: Tables):
    """Compositions of ten elements for the base peak of each target ion, protonated or with bromide, the 100 nearest within 1 ppm."""
    peaks = t.isotopes.where("k = 0").select(F.col("ion_id").alias("id"), "mz").distinct()
    ranges = t.spark.createDataFrame(_ranges(), "element string, low int, high int")
    found = search(peaks, ranges, t.mechanisms.where(F.col("mechanism").isin(*WAYS)), ppm=PPM, most=MOST)
    return found.select(F.col("id").alias("ion_id"), "mechanism", "formula", "unsaturation", F.round("ppm", 3).alias("ppm"), "place")
