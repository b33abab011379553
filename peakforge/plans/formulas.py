"""Queries on formulas as text and as counts: plausibility, notations, count ranges, enumeration."""

from __future__ import annotations

from pyspark.sql import functions as F

from peakforge.functions import chem, formula
from peakforge.operators.confidence import sigmoid
from peakforge.plans.registry import query
from peakforge.sources.fixtures import Tables

#: counts of formulas with heteroatoms, derived from parts; one definition for both engines
COUNTS = {"C": "p_size % 20", "H": "2 + (p_partkey * 7) % 60", "N": "p_partkey % 13", "O": "1 + (p_partkey * 3) % 24", "P": "p_partkey % 5", "S": "p_size % 5"}
RICH = "rich AS (SELECT p_partkey AS id, " + ", ".join(f"CAST({v} AS INT) AS {k.lower()}" for k, v in COUNTS.items()) + " FROM part)"
TEXT = "concat(" + ", ".join(f"'{k}', CAST({v} AS STRING)" for k, v in COUNTS.items()) + ")"


def rich(t: Tables):
    """(id, formula, counts) of every part: what the adapters of reference lists give.

    A file of parts is small and would be one task, but a formula takes a quarter of a millisecond, so rows are dealt out first.
    """
    parts = t.raw("part").select("p_partkey", "p_size").repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")))
    return parts.selectExpr("p_partkey AS id", f"{TEXT} AS formula").withColumn("counts", chem.element_counts(F.col("formula")))


def _falloff(v: str, edge: float, outer: float) -> str:
    """SQL of ``formula.falloff``."""
    steps = f"(({v} - {edge}e0) / ({outer}e0 - {edge}e0))"
    return f"greatest(0.1e0, least(1e0, greatest(1e0 - {steps} / 2e0, 0.5e0 - 0.4e0 * ({steps} - 1e0))))"


SENIOR = """(4 * c + h + 3 * n + 2 * o + CASE WHEN p > 0 THEN p * (3 + 2 * least((o + n) // (2 * p), 1)) ELSE 0 END
    + CASE WHEN s > 0 THEN s * (2 + 2 * least((o + n) // (2 * s), 2)) ELSE 0 END >= 2 * (c + h + n + o + p + s - 1))"""
_R = {e: formula.RATIOS[e] for e in ("H", "N", "O", "P", "S")}
RATIO = "CASE WHEN c = 0 THEN 1e0 ELSE greatest(0.1e0, " + " * ".join(
    f"CASE WHEN {e.lower()} = 0 THEN 1e0 ELSE least({_falloff(f'({e.lower()} / c)', b, d)}, {_falloff(f'({e.lower()} / c)', a, x) if a else '1e0'}) END" for e, (a, b, x, d) in _R.items()
) + ") END"


def _cap(e: str) -> str:
    caps = [f"CASE WHEN {' AND '.join(f'{k.lower()} > {v}' for k, v in above.items())} AND {e.lower()} > {c[e]} THEN {c[e]}e0 END" for above, c in formula.CAPS if e in c]
    return f"CASE WHEN least({', '.join(caps)}) IS NULL THEN 1e0 ELSE greatest(0.1e0, least({', '.join(caps)}) / {e.lower()}) END"


CAP = f"greatest(0.1e0, {' * '.join(map(_cap, 'NOPS'))})"


@query("formula_plausibility", f"WITH {RICH} SELECT id, round(CASE WHEN {SENIOR} THEN greatest(0.1e0, ({RATIO}) * {CAP}) ELSE 0e0 END, 6) AS plausibility FROM rich")
def _(t: Tables):
    return rich(t).select("id", F.round(formula.plausibility(F.col("counts")), 6).alias("plausibility"))


_RANGES = " AND ".join(f"(c = 0 OR {e.lower()} = 0 OR {e.lower()} / c BETWEEN {v[2]}e0 AND {v[3]}e0)" for e, v in _R.items())
_CAPPED = " AND ".join(
    f"(NOT ({' AND '.join(f'{k.lower()} > {v}' for k, v in above.items())}) OR ({' AND '.join(f'{k.lower()} <= {v}' for k, v in caps.items())}))" for above, caps in formula.CAPS
)


@query("heuristic_filter", f"WITH {RICH} SELECT id FROM rich WHERE {SENIOR} AND {_RANGES} AND {_CAPPED}")
def _(t: Tables):
    return rich(t).where(formula.usual(F.col("counts"))).select("id")


_HILL = "concat(" + ", ".join(f"CASE WHEN {e} = 0 THEN '' WHEN {e} = 1 THEN '{e.upper()}' ELSE '{e.upper()}' || {e} END" for e in "chnops") + ")"


@query("hill_order", f"WITH {RICH} SELECT id, {_HILL} AS hill FROM rich")
def _(t: Tables):
    return rich(t).select("id", chem.hill_order(F.col("counts")).alias("hill"))


@query(
    "finalize_reference",
    f"WITH {RICH} SELECT id, {_HILL} AS formula, round(12e0 * c + 1.00782503223e0 * h + 14.00307400443e0 * n + 15.99491461957e0 * o + 30.97376199842e0 * p + 31.9720711744e0 * s, 6) AS mass FROM rich WHERE id % 7 <> 0",
)
def _(t: Tables):
    text = F.when(F.col("id") % 7 == 0, F.concat("formula", F.lit("Xx2"))).otherwise(F.col("formula"))  # an element without a mass
    rows = rich(t).select("id", chem.element_counts(text).alias("counts"))
    mass = chem.monoisotopic_mass(F.col("counts"))
    return rows.where(mass.isNotNull()).select("id", chem.hill_order(F.col("counts")).alias("formula"), F.round(mass, 6).alias("mass"))


@query("normalize_isotopes", f"WITH {RICH} SELECT id, concat('CO', 'C', c, 'H', h) AS plain FROM rich")
def _(t: Tables):
    text = F.concat(F.lit("[13C][18O]"), F.regexp_extract("formula", "^(C[0-9]+H[0-9]+)", 1))
    return rich(t).select("id", formula.without_isotopes(text).alias("plain"))


@query("notation_convert", f"WITH {RICH} SELECT id, concat('C', c, '^N', n + 1) AS custom, concat('C', c, '[15N]', n + 1) AS explicit FROM rich")
def _(t: Tables):
    n = F.col("counts")
    text = F.concat(F.lit("C"), n["C"].cast("string"), F.lit("[15N]"), (n["N"] + 1).cast("string"))
    custom = F.regexp_replace(text, r"\[15N\]", "^N")
    return rich(t).select("id", custom.alias("custom"), F.regexp_replace(custom, r"\^N", "[15N]").alias("explicit"))


NOTATIONS = {0: "+H+", 1: "-H+", 2: "+(CH4N2O)H+", 3: "-"}
_CASE = "CASE mechanism " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in NOTATIONS.items()) + " END"


@query(
    "parse_ionization",
    f"""SELECT DISTINCT {_CASE} AS notation, mechanism IN (0, 2, 3) AS addition, CASE mechanism WHEN 2 THEN 'CH4N2OH' WHEN 3 THEN '' ELSE 'H' END AS body,
    CASE WHEN mechanism = 3 THEN -1 ELSE 1 END AS charge, round(CASE mechanism WHEN 2 THEN 12e0 + 5 * 1.00782503223e0 + 2 * 14.00307400443e0 + 15.99491461957e0 WHEN 3 THEN 0e0 ELSE 1.00782503223e0 END
    - 0.000548579909065e0 * CASE WHEN mechanism = 3 THEN -1 ELSE 1 END, 9) AS mass FROM isotopes""",
    "isotopes",
)
def _(t: Tables):
    notation = F.element_at(F.create_map(*(x for k, v in NOTATIONS.items() for x in (F.lit(k), F.lit(v)))), F.col("mechanism").cast("int"))
    rows = t.isotopes.select(notation.alias("notation")).distinct()
    rows = rows.select("notation", *(c.alias(k) for k, c in formula.ionization(F.col("notation")).items()))
    mass = chem.monoisotopic_mass(chem.element_counts(F.col("body"))) - chem.ELECTRON * F.col("charge")
    return rows.select("notation", "addition", "body", "charge", F.round(mass, 9).alias("mass"))


@query("neutral_of", f"WITH {RICH} SELECT id, {_HILL.replace('CASE WHEN h = 0', 'CASE WHEN h + d = 0').replace('WHEN h = 1', 'WHEN h + d = 1').replace(chr(39) + 'H' + chr(39) + ' || h', chr(39) + 'H' + chr(39) + ' || (h + d)')} AS neutral FROM (SELECT *, CASE WHEN id % 2 = 0 THEN -1 ELSE 1 END AS d FROM rich)")
def _(t: Tables):
    ion = rich(t).withColumn("notation", F.when(F.col("id") % 2 == 0, "+H+").otherwise("-H+"))
    parts = formula.ionization(F.col("notation"))
    added = chem.element_counts(parts["body"])
    sign = F.when(parts["addition"], -1).otherwise(1)
    neutral = F.map_zip_with("counts", added, lambda k, a, b: F.coalesce(a, F.lit(0)) + sign * F.coalesce(b, F.lit(0)))
    return ion.select("id", chem.hill_order(neutral).alias("neutral"))


@query(
    "isotope_ion_label",
    """SELECT isotope_id, concat(CASE k WHEN 0 THEN '' WHEN 1 THEN '[13C]' ELSE '[13C]' || k END, CASE WHEN c - k <= 0 THEN '' WHEN c - k = 1 THEN 'C' ELSE 'C' || (c - k) END, rest, '+') AS label
    FROM (SELECT isotope_id, k, CAST(regexp_extract(formula, 'C([0-9]+)', 1) AS INT) AS c, regexp_extract(formula, '(H.*)', 1) AS rest FROM isotopes)""",
    "isotopes",
)
def _(t: Tables):
    c, k = F.regexp_extract("formula", "C([0-9]+)", 1).cast("int") - F.col("k"), F.col("k")
    heavy = F.when(k == 0, "").when(k == 1, "[13C]").otherwise(F.concat(F.lit("[13C]"), k.cast("string")))
    light = F.when(c <= 0, "").when(c == 1, "C").otherwise(F.concat(F.lit("C"), c.cast("string")))
    return t.isotopes.select("isotope_id", F.concat(heavy, light, F.regexp_extract("formula", "(H.*)", 1), F.lit("+")).alias("label"))


@query(
    "parse_count_ranges",
    """SELECT id, regexp_extract(token, '^(\\[[0-9]+[A-Z][a-z]?\\]|[A-Z][a-z]?)[0-9]+-[0-9]+$', 1) AS symbol, CAST(regexp_extract(token, '([0-9]+)-[0-9]+$', 1) AS INT) AS low,
    CAST(regexp_extract(token, '-([0-9]+)$', 1) AS INT) AS high FROM (SELECT p_partkey AS id, unnest(string_split(concat('C0-', p_size, ' H0-', 2 * p_size, ' [13C]', p_size % 2, '-2'), ' ')) AS token FROM part)""",
)
def _(t: Tables):
    text = F.concat(F.lit("C0-"), F.col("p_size").cast("string"), F.lit(" H0-"), (2 * F.col("p_size")).cast("string"), F.lit(" [13C]"), (F.col("p_size") % 2).cast("string"), F.lit("-2"))
    rows = t.raw("part").select(F.col("p_partkey").alias("id"), F.explode(F.split(text, " +")).alias("token"))
    part = lambda k: F.regexp_extract("token", r"^(\[[0-9]+[A-Z][a-z]?\]|[A-Z][a-z]?)([0-9]+)-([0-9]+)$", k)
    return rows.select("id", part(1).alias("symbol"), part(2).cast("int").alias("low"), part(3).cast("int").alias("high"))


@query("ppm_to_da", "SELECT isotope_id, round(mz * 5e0 * 1e-6, 9) AS tolerance FROM isotopes", "isotopes")
def _(t: Tables):
    return t.isotopes.select("isotope_id", F.round(F.col("mz") * 5.0 * 1e-6, 9).alias("tolerance"))


#: fixed values of the calibration of the second score version
SLOPE, OFFSET = 6.0546, -4.1481


@query("sigmoid_calibrate", f"SELECT doc_id, round(1e0 / (1e0 + exp(-({SLOPE}e0 * confidence + {OFFSET}e0))), 6) AS p FROM labelled", "labelled")
def _(t: Tables):
    return t.labelled.select("doc_id", F.round(sigmoid(F.col("confidence"), SLOPE, OFFSET), 6).alias("p"))


@query("corroboration_score", "SELECT compound_id, n, CASE WHEN n <= 1 THEN 0e0 ELSE 1e0 - pow(2e0, -(n - 1)) END AS score FROM (SELECT compound_id, count(DISTINCT mechanism) AS n FROM isotopes GROUP BY compound_id)", "isotopes")
def _(t: Tables):
    n = t.isotopes.groupBy("compound_id").agg(F.countDistinct("mechanism").alias("n"))
    return n.withColumn("score", F.when(F.col("n") <= 1, 0.0).otherwise(1 - F.pow(F.lit(2.0), -(F.col("n") - 1))))


@query(
    "fit_inchikey",
    """SELECT id, CASE WHEN length(v) = 0 THEN NULL WHEN length(v) <= 27 THEN v END AS inchikey FROM (SELECT p_partkey AS id, trim(CASE p_partkey % 4 WHEN 0 THEN '' ELSE
    substr(upper(md5(p_name)), 1, CASE WHEN p_partkey % 4 = 3 THEN 30 ELSE 27 END) END) AS v FROM part)""",
)
def _(t: Tables):
    raw = F.when(F.col("p_partkey") % 4 == 0, "").otherwise(
        F.concat(F.when(F.col("p_partkey") % 4 == 1, " InChIKey= ").otherwise(""), F.when(F.col("p_partkey") % 4 == 3, F.substring(F.upper(F.md5("p_name")), 1, 30)).otherwise(F.substring(F.upper(F.md5("p_name")), 1, 27)))
    )
    key = F.trim(F.regexp_replace(F.trim(raw), "(?i)^inchikey=", ""))
    return t.raw("part").select(F.col("p_partkey").alias("id"), F.when((F.length(key) > 0) & (F.length(key) <= 27), key).alias("inchikey"))
