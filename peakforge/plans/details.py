"""Queries whose result is data and not a count: spectra of batches, centroids, envelopes, verdicts, names of files, scores of a search."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from peakforge.functions import chem, formula
from peakforge.operators import confidence, joins, matching
from peakforge.operators.confidence import sigmoid
from peakforge.plans.analytics import OFFSET, SLOPE
from peakforge.plans.matching import FIT
from peakforge.plans.patterns import PLAUSIBLE, plausible
from peakforge.plans.registry import query
from peakforge.sources import filenames
from peakforge.sources.fixtures import Tables
from peakforge.sources.verdicts import Verdicts

#: names of sample files in all forms, some without a time or a class, derived from orders; one definition for both engines
_AT = "o_orderdate + (o_orderkey * 37) % 86400 * INTERVAL 1 SECOND"
_FORMS = [("yyyy.MM.dd-HH'h'mm'm'ss's'", "%Y.%m.%d-%Hh%Mm%Ss"), ("yyyyMMdd'_'HHmm'_a'", "%Y%m%d_%H%M_a"), ("yyyyMMddHHmmss", "%Y%m%d%H%M%S"), ("yyyyMMdd'-'HHmmss", "%Y%m%d-%H%M%S"), ("yyyyMMdd'-'HHmm'x'", "%Y%m%d-%H%Mx"), ("yyyyMMdd", "%Y%m%d"), ("'99999999-'HH", "99999999-%H")]
_INSTRUMENTS = ["Orbi-1", "TOF-2", "apiX", "Lab3"]


def _name_sql(engine: int) -> str:
    form = "date_format" if engine == 0 else "strftime"
    quote = lambda f: "'" + f.replace("'", "\\'" if engine == 0 else "''") + "'"
    times = " ".join(f"WHEN {k} THEN {form}(made, {quote(f[engine])})" for k, f in enumerate(_FORMS))
    names = " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(_INSTRUMENTS))
    return f"concat(CASE o_orderkey % {len(_INSTRUMENTS)} {names} END, '_', CASE o_custkey % {len(_FORMS)} {times} END, '_s')"


@query(
    "scan_filename_meta",
    f"""WITH f AS (SELECT o_orderkey AS id, {_name_sql(1)} AS name FROM (SELECT *, {_AT} AS made FROM orders)), p AS (SELECT id, name, split_part(name, '_', 1) AS instrument FROM f)
    SELECT id, name, instrument, CASE WHEN lower(instrument) LIKE '%orbi%' THEN 'orbi' WHEN lower(instrument) LIKE '%tof%' OR lower(instrument) LIKE '%api%' THEN 'tof' END AS kind, {filenames.acquired_sql("name")} AS acquired FROM p""",
)
def _(t: Tables):
    """Instrument, its class and the time of acquisition from names of files in six forms."""
    made = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=(F.col("o_orderkey") * 37) % 86400)
    rows = t.raw("orders").withColumn("made", made).select(F.col("o_orderkey").alias("id"), F.expr(_name_sql(0)).alias("name"))
    rows = rows.withColumn("instrument", filenames.instrument(F.col("name")))
    return rows.select("id", "name", "instrument", filenames.instrument_class(F.col("instrument")).alias("kind"), filenames.acquired(F.col("name")).alias("acquired"))


@query(
    "batch_spectra",
    """WITH b AS (SELECT batch, count(DISTINCT instrument) AS kinds FROM samples GROUP BY batch)
    SELECT s.batch, p.polarity, p.sid, p.peak_id, round(p.mz, 7) AS mz, p.intensity, false AS refused FROM peaks p JOIN samples s USING (sid) JOIN b USING (batch) WHERE kinds = 1
    UNION ALL SELECT batch, NULL, NULL, NULL, NULL, NULL, true FROM b WHERE kinds > 1""",
    "peaks samples",
)
def _(t: Tables):
    """The peaks of all samples of a batch, by polarity; a batch of several kinds of instrument is refused and has one row that says so."""
    kinds = t.samples.groupBy("batch").agg(F.countDistinct("instrument").alias("kinds"))
    samples = t.samples.select("sid", "batch").join(kinds.where("kinds = 1"), "batch", "left_semi")
    rows = t.peaks.join(samples, "sid").select("batch", "polarity", "sid", "peak_id", F.round("mz", 7).alias("mz"), "intensity", F.lit(False).alias("refused"))
    return rows.unionByName(kinds.where("kinds > 1").select("batch", F.lit(True).alias("refused")), allowMissingColumns=True)


@query(
    "centroids_per_scan",
    """WITH f AS (SELECT sid, median(target_mz / peak_mz) AS factor FROM matches WHERE found AND collection_type = 'CALIBRANTS' AND abs(mz_error) <= 15 GROUP BY sid)
    SELECT p.sid, p.ts, p.peak_id, round(p.mz * coalesce(factor, 1e0), 7) AS mz, p.intensity, p.snr FROM peaks p LEFT JOIN f USING (sid) WHERE p.snr >= 3""",
    "matches peaks",
)
def _(t: Tables):
    """The centroids of each scan, on the mass axis that the sample's calibrants fit."""
    good = t.near_of("collection_type = 'CALIBRANTS'", 15.0)
    factor = good.groupBy("sid").agg(F.median(F.col("target_mz") / F.col("peak_mz")).alias("factor"))
    rows = t.peaks.where("snr >= 3").join(factor, "sid", "left")
    return rows.select("sid", "ts", "peak_id", F.round(F.col("mz") * F.coalesce("factor", F.lit(1.0)), 7).alias("mz"), "intensity", "snr")


@query(
    "visual_isotope_context",
    """WITH n AS (SELECT p.sid, i.isotope_id, p.peak_id, p.mz, p.intensity FROM peaks p JOIN isotopes i ON p.mz BETWEEN i.mz - 0.25e0 AND i.mz + 0.25e0)
    SELECT m.sid, m.isotope_id, round(CASE WHEN main_abundance > 0 THEN main_intensity * relative_abundance / main_abundance END, 8) AS expected, n.peak_id, round(n.mz, 6) AS mz, n.intensity,
    coalesce(n.peak_id = m.peak_id, false) AS matched FROM matches m LEFT JOIN n USING (sid, isotope_id)""",
    "peaks isotopes matches",
)
def _(t: Tables):
    """Each isotope of an ion in a sample with the peaks around it, the height that the main isotope lets expect, and which peak was matched."""
    i = t.isotopes.select("isotope_id", "ion_id", "mz", "relative_abundance")
    met = joins.met_ions(t.peaks, i, key="sid", window=0.5, around=0.25)
    met = met.select("sid", F.coalesce(F.col("near")[0]["intensity"], F.lit(0.0)).alias("main_intensity"), F.col("isotopes")[0]["relative_abundance"].alias("main_abundance"), F.explode(F.arrays_zip("isotopes", "near", "around")).alias("x"))
    m = met.select("sid", "main_intensity", "main_abundance", "x.isotopes.isotope_id", "x.isotopes.relative_abundance", "x.near.peak_id", F.explode_outer("x.around").alias("n"))
    m = m.select("*", F.col("n.peak_id").alias("near_id"), "n.mz", F.col("n.intensity").alias("height"))
    expected = F.when(F.col("main_abundance") > 0, F.col("main_intensity") * F.col("relative_abundance") / F.col("main_abundance"))
    matched = F.coalesce(F.col("near_id") == F.col("peak_id"), F.lit(False))
    return m.select("sid", "isotope_id", F.round(expected, 8).alias("expected"), F.col("near_id").alias("peak_id"), F.round("mz", 6).alias("mz"), F.col("height").alias("intensity"), matched.alias("matched"))


@query(
    "composition_fit",
    f"""WITH {FIT} SELECT m.sid, m.ion_id, m.isotope_id, round(relative_abundance / main_abundance, 6) AS predicted, round(intensity_relative, 6) AS observed, CASE WHEN found THEN round(mz_error, 6) END AS ppm, found,
    round(fit_score, 6) AS fit FROM matches m JOIN fit USING (sid, ion_id)""",
    "matches",
)
def _(t: Tables):
    """The envelope of each composition against each sample: predicted and observed heights of its isotopes, mass errors, and the fit of the whole."""
    rows = matching.with_fit(t.matches)
    predicted = F.round(F.col("relative_abundance") / F.col("main_abundance"), 6)
    ppm = F.when(F.col("found"), F.round("mz_error", 6))
    return rows.select("sid", "ion_id", "isotope_id", predicted.alias("predicted"), F.round("intensity_relative", 6).alias("observed"), ppm.alias("ppm"), "found", F.round("fit_score", 6).alias("fit"))


@query(
    "search_candidate_scores",
    "WITH "
    + FIT.replace("FROM matches WINDOW", "FROM (SELECT m.*, s.instrument FROM matches m JOIN samples s USING (sid)) mm WINDOW").replace(
        "sqrt(4e0 + pow(", "sqrt(pow(CASE WHEN instrument = 'orbi' THEN 5e0 / 3e0 ELSE 5e0 END, 2) + pow("
    )
    + f""", {PLAUSIBLE} SELECT sid, ion_id, round(fit_score, 6) AS fit_score, round(plausibility, 6) AS plausibility,
    CASE WHEN fit_score >= 0.8e0 THEN 'identified' WHEN fit_score >= 0.5e0 THEN 'candidate' ELSE 'below_assignability' END AS tier FROM fit JOIN (SELECT DISTINCT ion_id, formula FROM isotopes) USING (ion_id) JOIN pl USING (formula)""",
    "matches samples isotopes",
)
def _(t: Tables):
    """Fit, plausibility and tier of each ion that a search finds in a sample; the spread of mass errors is a third of the instrument's tolerance."""
    rows = t.matches.join(t.samples.select("sid", "instrument"), "sid")
    fit = matching.fit_score_v2(rows, F.when(F.col("instrument") == "orbi", 5.0 / 3.0).otherwise(5.0))
    known = t.isotopes.select("ion_id", "formula").distinct().withColumn("plausibility", formula.plausibility(chem.element_counts(F.col("formula"))))
    scored = fit.join(known, "ion_id")
    return scored.select("sid", "ion_id", F.round("fit_score", 6).alias("fit_score"), F.round("plausibility", 6).alias("plausibility"), matching.tier(F.col("fit_score")).alias("tier"))


@query(
    "apply_corroboration",
    """WITH a AS (SELECT sid, compound_id, ion_id, mechanism, max(score) AS p FROM gated WHERE score > 0 GROUP BY ALL),
    s AS (SELECT DISTINCT sid, compound_id, mechanism FROM a), n AS (SELECT *, count(*) OVER (PARTITION BY sid, compound_id) > 1 AS shared FROM s),
    w AS (SELECT mechanism, ln((count(*) FILTER (shared) + 0.5e0) / (count(*) FILTER (NOT shared) + 0.5e0)) AS weight FROM n GROUP BY mechanism),
    d AS (SELECT a.sid, a.compound_id, a.ion_id, any_value(a.p) AS p, coalesce(sum(w.weight) FILTER (s.mechanism <> a.mechanism), 0e0) AS x FROM a JOIN s USING (sid, compound_id) JOIN w ON w.mechanism = s.mechanism GROUP BY a.sid, a.compound_id, a.ion_id)
    SELECT sid, ion_id, round(1e0 / (1e0 + exp(-(ln(q / (1e0 - q)) + greatest(-3e0, least(3e0, x))))), 6) AS p FROM (SELECT *, least(greatest(p, 1e-9), 1e0 - 1e-9) AS q FROM d)""",
    "gated",
)
def _(t: Tables):
    """Probabilities moved by what other adducts of the compound show in the sample; an adduct's weight is the log odds that it is seen beside another one."""
    a = t.gated.where("score > 0").groupBy("sid", "compound_id", "ion_id", "mechanism").agg(F.max("score").alias("p"))
    seen = a.select("sid", "compound_id", "mechanism").distinct()
    alone = seen.withColumn("shared", (F.count("*").over(W.partitionBy("sid", "compound_id")) > 1).cast("int"))  # as many rows as mechanisms
    weights = alone.groupBy("mechanism").agg(F.ln((F.sum("shared") + 0.5) / (F.sum(1 - F.col("shared")) + 0.5)).alias("weight"))
    others = seen.join(weights, "mechanism").select("sid", "compound_id", F.col("mechanism").alias("other"), "weight")
    x = F.coalesce(F.sum(F.when(F.col("other") != F.col("mechanism"), F.col("weight"))), F.lit(0.0))
    rows = a.join(others, ["sid", "compound_id"]).groupBy("sid", "compound_id", "ion_id", "p").agg(x.alias("x"))
    q = F.least(F.greatest("p", F.lit(1e-9)), F.lit(1 - 1e-9))
    z = F.ln(q / (1 - q)) + F.greatest(F.lit(-3.0), F.least(F.lit(3.0), F.col("x")))
    return rows.select("sid", "ion_id", F.round(1 / (1 + F.exp(-z)), 6).alias("p"))


@query(
    "annotate_candidates",
    """WITH k AS (SELECT formula, string_agg(DISTINCT compound_name, '|' ORDER BY compound_name) AS names FROM isotopes WHERE collection_type = 'TARGETS' GROUP BY formula)
    SELECT c.ion_id, c.formula, k.names, k.formula IS NOT NULL AS known FROM (SELECT DISTINCT ion_id, formula FROM isotopes) c LEFT JOIN k USING (formula)""",
    "isotopes",
)
def _(t: Tables):
    """Candidates with the names of known compounds of their formula: those of the target collections."""
    known = t.isotopes.where("collection_type = 'TARGETS'").select("formula", "compound_name")
    return annotated(t.isotopes.select("ion_id", "formula").distinct(), known)


def annotated(candidates, known, *, known_only: bool = False):
    """``candidates`` with ``names`` and ``known`` by their formula; with ``known_only`` those that are, and no others."""
    names = known.groupBy("formula").agg(F.array_join(F.array_sort(F.collect_set("compound_name")), "|").alias("names"))
    rows = candidates.join(names, "formula", "inner" if known_only else "left")
    return rows.select(*candidates.columns, "names", F.col("names").isNotNull().alias("known"))


_JUDGED = f"""g AS (SELECT doc_id, instrument, confidence, quality FROM labelled JOIN labels USING (doc_id)),
    v AS (SELECT doc_id AS assignment, instrument, CASE WHEN quality = 1 THEN 'confirmed' ELSE 'rejected' END AS verdict, CASE WHEN quality = 1 THEN 'standard' END AS evidence_level, confidence AS fit_score, 0 AS append FROM g
    UNION ALL SELECT doc_id, instrument, 'unsure', NULL, confidence / 2, 1 FROM g WHERE doc_id % 3 = 0),
    s AS (SELECT assignment, instrument, verdict, evidence_level, round(fit_score, 6) AS fit_score, round(fit_score * fit_score, 6) AS evidence, round(1e0 / (1e0 + exp(-({SLOPE}e0 * fit_score + {OFFSET}e0))), 6) AS p_correct, append FROM v)"""


def judged(t: Tables) -> Verdicts:
    """Verdicts of two days: all labelled winners, and a third of them again after a later run changed their scores."""
    store, rows = Verdicts(t.spark), t.labelled.join(t.raw("labels").select("doc_id", "quality"), "doc_id")
    score = lambda c: rows.select(F.col("doc_id").alias("assignment"), c.alias("fit_score"), (c * c).alias("evidence"), sigmoid(c, SLOPE, OFFSET).alias("p_correct"))
    good = F.col("quality") == 1
    first = rows.select(F.col("doc_id").alias("assignment"), F.when(good, "confirmed").otherwise("rejected").alias("verdict"), F.when(good, "standard").alias("evidence_level"))
    store.record(first, score(F.col("confidence")), 0)
    again = rows.where("doc_id % 3 = 0").select(F.col("doc_id").alias("assignment"), F.lit("unsure").alias("verdict"), F.lit(None).cast("string").alias("evidence_level"))
    store.record(again, score(F.col("confidence") / 2), 1)
    return store


@query("record_verification", f"WITH {_JUDGED} SELECT assignment, verdict, evidence_level, fit_score, evidence, p_correct, append FROM s", "labelled")
def _(t: Tables):
    """What is stored: each verdict with the scores at its time, which later runs don't change."""
    rounded = [F.round(c, 6).alias(c) for c in ("fit_score", "evidence", "p_correct")]
    return judged(t).all().select("assignment", "verdict", "evidence_level", *rounded, "append")


@query("list_verifications", f"WITH {_JUDGED} SELECT instrument, assignment, verdict, fit_score, row_number() OVER (PARTITION BY instrument ORDER BY append DESC, assignment DESC) AS place FROM s", "labelled")
def _(t: Tables):
    groups = t.labelled.select(F.col("doc_id").alias("assignment"), "instrument")
    return judged(t).newest_first(groups, "instrument").select("instrument", "assignment", "verdict", F.round("fit_score", 6).alias("fit_score"), "place")


@query(
    "acquisition_inventory",
    """WITH o AS (SELECT *, year(created) AS year FROM files WHERE status = 'P'), d AS (SELECT type, year, count(*) AS n, arg_min(file_id, {'c': created, 'f': file_id}) AS kept FROM o GROUP BY type, year)
    SELECT g.type AS instrument, g.year, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicated' ELSE 'present' END AS state, kept, coalesce(n - 1, 0) AS left_out
    FROM (SELECT * FROM (SELECT DISTINCT type FROM files), (SELECT DISTINCT year(created) AS year FROM files)) g LEFT JOIN d USING (type, year)""",
    "files",
)
def _(t: Tables):
    """Instruments by years of acquisition: whether a data set is there, missing or there more than once; of duplicates the oldest counts."""
    files = t.files.withColumn("year", F.year("created").cast("long"))
    oldest = F.min_by("file_id", F.struct("created", "file_id"))
    there = files.where("status = 'P'").groupBy("type", "year").agg(F.count("*").alias("n"), oldest.alias("kept"))
    years = files.agg(F.collect_set("year").alias("years"))  # one row with a few years
    grid = files.select("type").distinct().crossJoin(F.broadcast(years)).select("type", F.explode("years").alias("year"))
    state = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicated").otherwise("present")
    return grid.join(there, ["type", "year"], "left").select(F.col("type").alias("instrument"), "year", state.alias("state"), "kept", F.coalesce(F.col("n") - 1, F.lit(0)).alias("left_out"))


@query(
    "list_match_samples",
    """SELECT s.batch, s.sample_name, i.sid, max(i.category) AS category, count(*) FILTER (i.category = 2) AS probable FROM ions i JOIN samples s USING (sid) WHERE s.batch IN (SELECT DISTINCT batch FROM samples WHERE batch < 'NATION_2')
    GROUP BY ALL HAVING max(i.category) >= 1""",
    "ions samples",
)
def _(t: Tables):
    """The samples of some batches that hold an ion at least possible."""
    names = [r["batch"] for r in t.samples.select("batch").distinct().where("batch < 'NATION_2'").collect()]  # a name for each batch
    return match_samples_listed(t.ions, t.samples, batches=names, least=1)


def match_samples_listed(ions, samples, *, batches: list[str] | None = None, sids: list[int] | None = None, least: int = 0):
    """(batch, sample_name, sid, category, probable) of samples, by batch, by sample and by the least category of their best ion."""
    s = samples.select("batch", "sample_name", "sid")
    if batches is not None:
        s = s.where(F.col("batch").isin(batches))
    if sids is not None:
        s = s.where(F.col("sid").isin(sids))
    g = ions.join(s, "sid").groupBy("batch", "sample_name", "sid").agg(F.max("category").alias("category"), F.count_if(F.col("category") == 2).alias("probable"))
    return g.where(F.col("category") >= least)


@query(
    "arbitrate",
    f"""WITH {PLAUSIBLE}, c AS (SELECT peak_id, formula, max(fit) AS fit, max(plausibility) AS pl FROM (SELECT n.peak_id, i.formula, 1e0 - abs(n.mz - n.target_mz) AS fit FROM nearest n JOIN isotopes i USING (isotope_id)) JOIN pl USING (formula) GROUP BY ALL),
    e AS (SELECT *, fit * pl AS ev FROM c), t AS (SELECT *, sum(ev) OVER w AS total, max(ev) OVER w AS top FROM e WINDOW w AS (PARTITION BY peak_id)), n AS (SELECT *, top - ev <= greatest(0.1e0 * top, 0.005e0) AS near FROM t)
    SELECT peak_id, formula, CASE WHEN total > 0 THEN round(ev / total, 6) ELSE 0e0 END AS confidence, near AND (total <= 0 OR sum(CASE WHEN near THEN 1 ELSE 0 END) OVER (PARTITION BY peak_id) > 1) AS is_tie FROM n""",
    "nearest isotopes",
)
def _(t: Tables):
    """Formulas that compete for a peak, by how near their mass is and how plausible they are."""
    c = t.nearest.join(t.isotopes.select("isotope_id", "formula"), "isotope_id").join(plausible(t), "formula")
    c = c.select("peak_id", "formula", (1 - F.abs(F.col("mz") - F.col("target_mz"))).alias("fit_score"), "plausibility")
    return confidence.arbitrate(c).select("peak_id", "formula", F.round("confidence", 6).alias("confidence"), "is_tie")


@query(
    "list_match_ratings",
    """SELECT event_id AS rating_id, sid, ion, ts AS rated, CASE WHEN height > 20 THEN 1 ELSE 0 END AS rating FROM scans WHERE height > 20 AND ion IN ('click', 'view') AND sid < 100 AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'""",
    "scans",
)
def _(t: Tables):
    """Ratings of ions in samples: the good ones of two ions and some samples in a fortnight."""
    ratings = t.scans.select(F.col("event_id").alias("rating_id"), "sid", "ion", F.col("ts").alias("rated"), (F.col("height") > 20).cast("int").alias("rating"))
    return ratings_listed(ratings.where("sid < 100"), ions=["click", "view"], rating=1, since="2024-01-05", until="2024-01-20")


def ratings_listed(ratings, *, sids: list[int] | None = None, ions: list[str] | None = None, rating: int | None = None, since: str | None = None, until: str | None = None):
    """Ratings (rating_id, sid, ion, rated, rating) by sample, ion, value and time, the end of the range left out."""
    for column, listed in (("sid", sids), ("ion", ions)):
        if listed is not None:
            ratings = ratings.where(F.col(column).isin(listed))
    if rating is not None:
        ratings = ratings.where(F.col("rating") == rating)
    if since is not None:
        ratings = ratings.where(F.col("rated") >= F.lit(since).cast("timestamp"))
    if until is not None:
        ratings = ratings.where(F.col("rated") < F.lit(until).cast("timestamp"))
    return ratings


_BOUND_C, _BOUND_MASS, _LICENSES = 12, 200.0, ("cc0", "cc-by")
_LISTED = """listed AS (SELECT p_partkey AS id, concat('C', 1 + p_size % 20, 'H', 2 + p_partkey % 30, CASE p_partkey % 5 WHEN 0 THEN 'S2' WHEN 1 THEN 'N3' ELSE 'O2' END, CASE WHEN p_partkey % 7 = 0 THEN '+' ELSE '' END) AS formula,
    CASE p_size % 3 WHEN 0 THEN 'cc0' WHEN 1 THEN 'cc-by' ELSE 'proprietary' END AS license, 1 + p_size % 20 AS c, 2 + p_partkey % 30 AS h, p_partkey % 5 AS x, p_partkey % 7 = 0 AS ion FROM part)"""


@query(
    "within_composition_bound",
    f"WITH {_LISTED} SELECT id, formula FROM listed WHERE NOT ion AND x <> 0 AND license IN {_LICENSES} AND c <= {_BOUND_C} AND 12e0 * c + 1.00782503223e0 * h + CASE x WHEN 1 THEN 3 * 14.00307400443e0 ELSE 2 * 15.99491461957e0 END <= {_BOUND_MASS}e0",
)
def _(t: Tables):
    """Reference compounds that a search may take: neutral ones of C, H, N and O, of few carbons and little mass, under the licenses that are allowed."""
    third = F.when(F.col("p_partkey") % 5 == 0, "S2").when(F.col("p_partkey") % 5 == 1, "N3").otherwise("O2")
    text = F.concat(F.lit("C"), (1 + F.col("p_size") % 20).cast("string"), F.lit("H"), (2 + F.col("p_partkey") % 30).cast("string"), third, F.when(F.col("p_partkey") % 7 == 0, "+").otherwise(""))
    kind = F.when(F.col("p_size") % 3 == 0, "cc0").when(F.col("p_size") % 3 == 1, "cc-by").otherwise("proprietary")
    rows = t.raw("part").select(F.col("p_partkey").alias("id"), text.alias("formula"), kind.alias("license"))
    return within_bound(rows, elements=list("CHNO"), most_carbon=_BOUND_C, most_mass=_BOUND_MASS, licenses=list(_LICENSES)).select("id", "formula")


def within_bound(rows, *, elements: list[str], most_carbon: int | None = None, most_mass: float | None = None, neutral: bool = True, licenses: list[str] | None = None):
    """The rows of (formula, license) within a bound: no other elements, so many carbons and so much mass at most, no charge, an allowed license."""
    counts = chem.element_counts(F.regexp_replace("formula", "[+-]+$", ""))
    rows = rows.withColumn("_n", counts).where(F.size(F.array_except(F.map_keys("_n"), F.array(*map(F.lit, elements)))) == 0)
    if most_carbon is not None:
        rows = rows.where(formula.count(F.col("_n"), "C") <= most_carbon)
    if most_mass is not None:
        rows = rows.where(chem.monoisotopic_mass(F.col("_n")) <= most_mass)
    if neutral:
        rows = rows.where(~F.col("formula").rlike("[+-]$"))
    if licenses is not None:
        rows = rows.where(F.col("license").isin(licenses))
    return rows.drop("_n")
