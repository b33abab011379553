"""Spectra tables derived from the star-schema tables, as DataFrames and as SQL for the checks.

One definition of each expression serves both: numbers in exponent notation are doubles in either engine.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ISOTOPE_MZ = "5e1 + p_partkey * 0.45e0 + k * 1.003355e0"
ISOTOPE_ABUNDANCE = "CASE k WHEN 0 THEN 0.9e0 WHEN 1 THEN 0.9e0 * p_size / 1e2 ELSE 0.9e0 * p_size * p_size / 2e4 END"
COLLECTION_TYPE = "CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 'TARGETS' WHEN p_type IN ('SMALL', 'MEDIUM') THEN 'DIAGNOSTICS' ELSE 'CALIBRANTS' END"
PEAK_MZ = "(5e1 + l_partkey * 0.45e0 + (l_linenumber % 3) * 1.003355e0) * (1e0 + (l_discount - 0.05e0) * 2e-4)"
PEAK_ID = (
    "md5(concat_ws('|', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), "
    "CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING)))"
)
PARENT_MZ = "(1e2 + (l_orderkey % 40) * 11.25e0) * (1e0 + (l_orderkey % 5 - 2) * 1e-6)"
FORMULA = "concat('C', CAST(1 + p_size % 20 AS STRING), 'H', CAST(2 + p_size % 30 AS STRING), 'O', CAST(1 + p_partkey % 6 AS STRING))"

#: fixed mechanisms of ionization whose ions the references are compared with: notation, what is added or taken, charge
MECHANISMS = [("+H+", "H", 1), ("-H+", "H", -1), ("+Na+", "Na", 1), ("+NH4+", "NH4", 1), ("+Cl-", "Cl", -1), ("+Br-", "Br", -1)]


class Tables:
    """The driver's tables and the spectra tables on them, each made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def isotopes(self) -> DataFrame:
        """One row per target isotope, three per ion; three ions per compound."""
        rows = self.raw("part").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
        return rows.selectExpr(
            "p_partkey * 3 + k AS isotope_id", "p_partkey AS ion_id", "CAST(floor(p_partkey / 3) AS BIGINT) AS compound_id", "p_name AS compound_name",
            "p_brand AS collection_id", f"{COLLECTION_TYPE} AS collection_type", "p_size % 4 AS mechanism", "k",
            f"{ISOTOPE_MZ} AS mz", f"{ISOTOPE_ABUNDANCE} AS relative_abundance", f"{FORMULA} AS formula",
        )

    @cached_property
    def peaks(self) -> DataFrame:
        """One row per centroided peak of a sample."""
        return self.peaks_of(self.raw("lineitem"))

    @staticmethod
    def peaks_of(rows: DataFrame) -> DataFrame:
        return rows.selectExpr(
            "l_suppkey AS sid", f"{PEAK_ID} AS peak_id", f"{PEAK_MZ} AS mz", "l_extendedprice AS intensity", "l_quantity AS snr",
            "CASE WHEN l_linestatus = 'F' THEN '-' ELSE '+' END AS polarity", "l_shipdate AS ts", "l_returnflag AS flag",
        )

    @cached_property
    def samples(self) -> DataFrame:
        s, n, r = self.raw("supplier"), self.raw("nation"), self.raw("region")
        return (
            s.join(n, s.s_nationkey == n.n_nationkey)
            .join(r, n.n_regionkey == r.r_regionkey)
            .selectExpr("s_suppkey AS sid", "s_name AS sample_name", "n_name AS batch", "r_name AS dataset", "s_acctbal AS tic",
                        "CASE WHEN s_suppkey % 2 = 0 THEN 'orbi' ELSE 'tof' END AS instrument", "s_nationkey AS batch_no")
        )

    @cached_property
    def scans(self) -> DataFrame:
        """Per-scan heights of ions: user as sample, event type as ion."""
        return self.raw("events").selectExpr("event_id", "user_id AS sid", "event_type AS ion", "CAST(ts AS TIMESTAMP) AS ts", "value AS height", "props")

    @cached_property
    def files(self) -> DataFrame:
        return self.raw("orders").selectExpr("o_orderkey AS file_id", "o_custkey AS sid", "o_orderstatus AS status", "o_totalprice AS tic", "o_orderdate AS created", "o_orderpriority AS type")

    @cached_property
    def fragments(self) -> DataFrame:
        """One row per fragment peak: each order is a scan of one isolated parent, whose m/z scatters by a few ppm."""
        return self.raw("lineitem").selectExpr(
            "l_suppkey % 10 AS sid", "l_orderkey AS scan", f"{PARENT_MZ} AS parent_mz", "10 + 10 * (l_orderkey % 3) AS energy", f"{PEAK_ID} AS peak_id", f"{PEAK_MZ} AS mz",
            "l_extendedprice AS intensity", "l_quantity AS snr", "l_shipdate AS ts",
        )

    @cached_property
    def mechanisms(self) -> DataFrame:
        """(mechanism, addition, added, charge) of the listed notations, read by the parser of notations."""
        from peakforge.functions import chem, formula

        rows = self.spark.createDataFrame([(m,) for m, _, _ in MECHANISMS], "mechanism string")
        parts = formula.ionization(F.col("mechanism"))
        charge = F.when(parts["addition"], parts["charge"]).otherwise(-parts["charge"])
        return rows.select("mechanism", parts["addition"].alias("addition"), chem.element_counts(parts["body"]).alias("added"), charge.alias("charge"))

    @cached_property
    def nearest(self) -> DataFrame:
        from peakforge.operators.joins import nearest_peak

        return nearest_peak(self.peaks, self.isotopes, key="sid", target="isotope_id", window=0.5)

    @cached_property
    def matches(self) -> DataFrame:
        """Scored isotopes of every ion with a candidate in a sample, missing ones with defaults."""
        return self.matches_of("true")

    def matches_of(self, condition: str) -> DataFrame:
        """The rows of ``matches`` for the ions whose isotopes meet ``condition``: ions are independent, so the rest is never matched."""
        from peakforge.operators.joins import met_ions
        from peakforge.operators.matching import expected_of, match_stats

        some = self.isotopes.where(condition).drop("compound_name", "formula")
        return match_stats(expected_of(met_ions(self.peaks, some, key="sid", window=0.5), some))

    def near_of(self, condition: str, ppm: float | None = None, *also: str) -> DataFrame:
        """The found rows of ``matches`` for isotopes that meet ``condition``, within ``ppm`` if given, with what they tell without their ion's other isotopes."""
        from peakforge.operators.joins import nearest_peak

        near = nearest_peak(self.peaks, self.isotopes.where(condition), key="sid", target="isotope_id", window=0.5, ppm=ppm, also=also)
        return near.withColumn("mz_error", 1e6 * (F.col("mz") - F.col("target_mz")) / F.col("target_mz")).withColumnRenamed("mz", "peak_mz")

    def gated_of(self, condition: str) -> DataFrame:
        """The rows of ``gated`` for such ions. Samples are sent to the matches, of which each has thousands, not these to them."""
        from peakforge.operators.matching import apply_match_params

        return apply_match_params(self.matches_of(condition).join(F.broadcast(self.samples.select("sid", "instrument", "batch")), "sid"))

    @cached_property
    def gated(self) -> DataFrame:
        return self.gated_of("true")

    @cached_property
    def gated_ions(self) -> DataFrame:
        """The isotopes of ``gated`` by ion: one row for each ion in a sample."""
        from peakforge.operators.joins import dealt_ions, met_ions
        from peakforge.operators.matching import gated_ions
        from peakforge.operators.rollup import ion_groups

        named = self.isotopes.select("ion_id", "isotope_id", "mz", "relative_abundance", "compound_id", "collection_id", "collection_type")
        # what a group tells need not stand beside each isotope too: these rows are copied for each sample
        slim = F.transform("isotopes", lambda i: F.struct(i["isotope_id"].alias("isotope_id"), i["mz"].alias("mz"), i["relative_abundance"].alias("relative_abundance")))
        dealt = ion_groups(dealt_ions(named, 0.5)).withColumn("isotopes", slim)
        met = met_ions(self.peaks, named, key="sid", window=0.5, dealt=dealt)
        return gated_ions(met.join(F.broadcast(self.samples.select("sid", "instrument", "batch")), "sid"))

    @cached_property
    def ions(self) -> DataFrame:
        from peakforge.operators.rollup import match_ions_met

        return match_ions_met(self.gated_ions)

    @cached_property
    def labelled(self) -> DataFrame:
        """Labelled winners: confidence from a document's length, verdict from its quality label."""
        d, lab = self.raw("documents"), self.raw("labels")
        return d.join(lab, "doc_id").selectExpr("doc_id", "least(1e0, n_chars / 5e3) AS confidence", "quality = 1 AS is_correct", "source AS instrument")


#: name -> (names it builds on, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "isotopes": (
        (),
        f"""SELECT p_partkey * 3 + k AS isotope_id, p_partkey AS ion_id, CAST(floor(p_partkey / 3) AS BIGINT) AS compound_id, p_name AS compound_name,
        p_brand AS collection_id, {COLLECTION_TYPE} AS collection_type, p_size % 4 AS mechanism, k, {ISOTOPE_MZ} AS mz,
        {ISOTOPE_ABUNDANCE} AS relative_abundance, {FORMULA} AS formula FROM part, (VALUES (0), (1), (2)) AS kk(k)""",
    ),
    "peaks": (
        (),
        f"""SELECT l_suppkey AS sid, {PEAK_ID} AS peak_id, {PEAK_MZ} AS mz, l_extendedprice AS intensity, l_quantity AS snr,
        CASE WHEN l_linestatus = 'F' THEN '-' ELSE '+' END AS polarity, l_shipdate AS ts, l_returnflag AS flag FROM lineitem""",
    ),
    "fragments": (
        (),
        f"""SELECT l_suppkey % 10 AS sid, l_orderkey AS scan, {PARENT_MZ} AS parent_mz, 10 + 10 * (l_orderkey % 3) AS energy, {PEAK_ID} AS peak_id, {PEAK_MZ} AS mz,
        l_extendedprice AS intensity, l_quantity AS snr, l_shipdate AS ts FROM lineitem""",
    ),
    "samples": (
        (),
        """SELECT s_suppkey AS sid, s_name AS sample_name, n_name AS batch, r_name AS dataset, s_acctbal AS tic,
        CASE WHEN s_suppkey % 2 = 0 THEN 'orbi' ELSE 'tof' END AS instrument, s_nationkey AS batch_no
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    ),
    "scans": ((), "SELECT event_id, user_id AS sid, event_type AS ion, ts, value AS height, props FROM events"),
    "files": ((), "SELECT o_orderkey AS file_id, o_custkey AS sid, o_orderstatus AS status, o_totalprice AS tic, o_orderdate AS created, o_orderpriority AS type FROM orders"),
    "cand": (
        ("peaks", "isotopes"),
        """SELECT p.sid, i.isotope_id, i.ion_id, i.mz AS target_mz, p.peak_id, p.mz, p.intensity, p.snr, abs(p.mz - i.mz) AS diff
        FROM peaks p JOIN isotopes i ON p.mz BETWEEN i.mz - 0.5e0 AND i.mz + 0.5e0""",
    ),
    "nearest": (
        ("cand",),
        """SELECT sid, isotope_id, ion_id, target_mz, peak_id, mz, intensity, snr FROM (
        SELECT *, row_number() OVER (PARTITION BY sid, isotope_id ORDER BY diff, mz, peak_id) AS rn FROM cand) WHERE rn = 1""",
    ),
    "expected": (
        ("nearest", "isotopes"),
        """SELECT e.sid, i.isotope_id, i.ion_id, i.compound_id, i.collection_id, i.collection_type, i.mechanism, i.k, i.mz AS target_mz, i.relative_abundance,
        n.peak_id, coalesce(n.mz, i.mz) AS peak_mz, coalesce(n.intensity, 0e0) AS intensity, n.snr, n.peak_id IS NOT NULL AS found
        FROM (SELECT DISTINCT sid, ion_id FROM nearest) e JOIN isotopes i USING (ion_id)
        LEFT JOIN nearest n ON n.sid = e.sid AND n.isotope_id = i.isotope_id""",
    ),
    "matches": (
        ("expected",),
        """SELECT *, CASE WHEN found THEN (1e0 - least(1e0, abs(abundance_error))) * greatest(0e0, 1e0 - abs(mz_error) / 1e2) ELSE 0e0 END AS score FROM (
        SELECT *, CASE WHEN NOT found THEN 1e0 WHEN main_abundance = 0e0 OR relative_abundance = 0e0 THEN 0e0
            ELSE intensity_relative / (relative_abundance / main_abundance) - 1e0 END AS abundance_error FROM (
        SELECT *, CASE WHEN main_intensity > 0e0 THEN intensity / main_intensity ELSE 0e0 END AS intensity_relative,
            CASE WHEN found THEN 1e6 * (peak_mz - target_mz) / target_mz ELSE 0e0 END AS mz_error FROM (
        SELECT *, first_value(intensity) OVER w AS main_intensity, first_value(relative_abundance) OVER w AS main_abundance
        FROM expected WINDOW w AS (PARTITION BY sid, ion_id ORDER BY relative_abundance DESC, target_mz, isotope_id))))""",
    ),
    "gated": (
        ("matches", "samples"),
        """SELECT * REPLACE (CASE WHEN within THEN intensity ELSE 0e0 END AS intensity, CASE WHEN within AND intensity >= 0e0 THEN score ELSE 0e0 END AS score),
            CASE WHEN NOT (within AND intensity >= 0e0) THEN 0 WHEN score >= 0.8e0 THEN 2 WHEN score >= 0.7e0 THEN 1 ELSE 0 END AS category FROM (
        SELECT m.*, s.instrument, s.batch, abs(mz_error) <= CASE WHEN s.instrument = 'orbi' THEN 5e0 ELSE 15e0 END
            AND abs(abundance_error) <= CASE WHEN s.instrument = 'orbi' THEN 0.2e0 ELSE 0.15e0 END AS within
        FROM matches m JOIN samples s USING (sid))""",
    ),
    "ions": (
        ("gated",),
        """SELECT *, CASE WHEN score >= 0.8e0 THEN 2 WHEN score >= 0.7e0 THEN 1 ELSE 0 END AS category FROM (
        SELECT sid, ion_id, compound_id, collection_id, min(collection_type) AS collection_type, sum(score * relative_abundance) AS score,
            sum(intensity) AS intensity FROM gated GROUP BY ALL)""",
    ),
    "labelled": (
        (),
        "SELECT doc_id, least(1e0, n_chars / 5e3) AS confidence, quality = 1 AS is_correct, source AS instrument FROM documents JOIN labels USING (doc_id)",
    ),
}


def with_views(sql: str, *names: str) -> str:
    """``sql`` with the views it names, and those they build on, before it."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in VIEWS[name][0]:
            add(other)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    if not order:
        return sql
    head = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n][1]})" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[len('WITH RECURSIVE ') :]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
