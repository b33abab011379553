"""Queries on the catalogue: joins, listings, pages, audits and upserts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from peakforge.operators import joins
from peakforge.plans.registry import query
from peakforge.sources.fixtures import Tables


@query(
    "target_chain",
    """SELECT s.batch, i.collection_id, i.compound_id, i.ion_id, i.isotope_id FROM (SELECT DISTINCT batch, batch_no FROM samples) s
    JOIN isotopes i ON i.mechanism = s.batch_no % 4 WHERE i.collection_type <> 'CALIBRANTS'""",
    "samples isotopes",
)
def _(t: Tables):
    b = t.samples.select("batch", "batch_no").distinct().select("batch", (F.col("batch_no") % 4).alias("mechanism"))
    return b.join(t.isotopes.where("collection_type <> 'CALIBRANTS'"), "mechanism").select("batch", "collection_id", "compound_id", "ion_id", "isotope_id")


@query(
    "sample_view",
    "SELECT f.file_id, s.sid, s.sample_name, s.instrument, f.status, f.tic FROM files f JOIN samples s ON s.sid = f.sid",
    "files samples",
)
def _(t: Tables):
    return t.files.join(t.samples.drop("tic"), "sid").select("file_id", "sid", "sample_name", "instrument", "status", "tic")


@query(
    "samples_with_match",
    """SELECT s.sid, s.batch, m.score, coalesce(m.alarming, 0) AS alarming FROM samples s LEFT JOIN (SELECT sid, round(max(score), 6) AS score,
    max(CASE WHEN collection_type = 'TARGETS' THEN 1 ELSE 0 END) AS alarming FROM ions GROUP BY sid) m USING (sid)""",
    "samples ions",
)
def _(t: Tables):
    m = t.ions.groupBy("sid").agg(F.round(F.max("score"), 6).alias("score"), F.max((F.col("collection_type") == "TARGETS").cast("int")).alias("alarming"))
    return t.samples.join(m, "sid", "left").select("sid", "batch", "score", F.coalesce("alarming", F.lit(0)).alias("alarming"))


@query(
    "filter_samples",
    "SELECT sid, sample_name, tic FROM samples WHERE instrument = 'orbi' AND dataset IN ('AFRICA', 'ASIA', 'EUROPE') AND tic BETWEEN 0 AND 9000",
    "samples",
)
def _(t: Tables):
    return t.samples.where("instrument = 'orbi' AND dataset IN ('AFRICA', 'ASIA', 'EUROPE') AND tic BETWEEN 0 AND 9000").select("sid", "sample_name", "tic")


@query(
    "match_names",
    """SELECT p_partkey AS id, contains(lower(p_name), 'ring') AS literal, lower(p_name) = 'small ring' AS exact, regexp_matches(p_name, '^s.*(ring|bolt)$') AS pattern FROM part""",
)
def _(t: Tables):
    n = F.col("p_name")
    return t.raw("part").select(
        F.col("p_partkey").alias("id"), F.lower(n).contains("ring").alias("literal"), (F.lower(n) == "small ring").alias("exact"), n.rlike("^s.*(ring|bolt)$").alias("pattern")
    )


@query("resolve_id", "SELECT n_name AS name, min(n_nationkey) AS id, count(*) AS n FROM nation GROUP BY n_name HAVING count(*) = 1")
def _(t: Tables):
    g = t.raw("nation").groupBy(F.col("n_name").alias("name")).agg(F.min("n_nationkey").alias("id"), F.count("*").alias("n"))
    return g.where("n = 1")


@query(
    "clamp_time_range",
    """SELECT sid, greatest(first, TIMESTAMP '2024-01-05') AS t0, least(last, TIMESTAMP '2024-01-20') AS t1, first > TIMESTAMP '2024-01-20' OR last < TIMESTAMP '2024-01-05' AS disjoint
    FROM (SELECT sid, min(ts) AS first, max(ts) AS last FROM scans GROUP BY sid)""",
    "scans",
)
def _(t: Tables):
    g = t.scans.groupBy("sid").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    a, b = F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-20").cast("timestamp")
    return g.select("sid", F.greatest("first", a).alias("t0"), F.least("last", b).alias("t1"), ((F.col("first") > b) | (F.col("last") < a)).alias("disjoint"))


@query(
    "sanitize_non_finite",
    """SELECT count(*) AS n, count(*) FILTER (WHERE bad) AS repaired, round(sum(CASE WHEN bad THEN 0e0 ELSE x END), 4) AS total FROM (
    SELECT l_quantity = 1 OR l_quantity = 2 AS bad, l_extendedprice AS x FROM lineitem)""",
)
def _(t: Tables):
    x = F.when(F.col("l_quantity") == 1, F.lit(float("nan"))).when(F.col("l_quantity") == 2, F.lit(float("inf"))).otherwise(F.col("l_extendedprice"))
    rows = t.raw("lineitem").select(x.alias("x"))
    bad = F.isnan("x") | (F.abs("x") == float("inf"))
    return rows.agg(F.count("*").alias("n"), F.count_if(bad).alias("repaired"), F.round(F.sum(F.when(bad, 0.0).otherwise(F.col("x"))), 4).alias("total"))


@query("fix_timestamps", "SELECT file_id, CASE WHEN created >= TIMESTAMP '1997-01-01' THEN created - INTERVAL 3 HOUR ELSE created END AS created FROM files", "files")
def _(t: Tables):
    late = F.col("created") >= F.lit("1997-01-01").cast("timestamp")
    return t.files.select("file_id", F.when(late, F.expr("created - INTERVAL 3 HOURS")).otherwise(F.col("created")).alias("created"))


@query("blank_samples", "SELECT c_custkey AS sid FROM customer WHERE c_custkey NOT IN (SELECT sid FROM files)", "files")
def _(t: Tables):
    return t.raw("customer").select(F.col("c_custkey").alias("sid")).join(t.files.select("sid"), "sid", "left_anti")


@query(
    "verified_calibration_gate",
    """SELECT s.sid FROM samples s JOIN (SELECT sid FROM matches WHERE found AND collection_type = 'CALIBRANTS' AND abs(mz_error) <= 5 GROUP BY sid HAVING count(*) >= 5) c USING (sid) WHERE s.tic > 0""",
    "samples matches",
)
def _(t: Tables):
    enough = t.matches_of("collection_type = 'CALIBRANTS'").where("found AND abs(mz_error) <= 5").groupBy("sid").count().where("count >= 5")
    return t.samples.where("tic > 0").select("sid").join(enough.select("sid"), "sid", "left_semi")


@query("unevaluated_isotopes", "SELECT isotope_id FROM isotopes WHERE ion_id NOT IN (SELECT ion_id FROM gated WHERE score > 0)", "isotopes gated")
def _(t: Tables):
    done = t.gated.where("score > 0").select("ion_id")
    return t.isotopes.join(done, "ion_id", "left_anti").select("isotope_id")


@query(
    "main_isotope_refs",
    """SELECT sid, ion_id, isotope_id, intensity FROM (SELECT *, row_number() OVER (PARTITION BY sid, ion_id ORDER BY relative_abundance DESC, target_mz, isotope_id) AS rn
    FROM matches WHERE found) WHERE rn = 1""",
    "matches",
)
def _(t: Tables):
    order = F.struct(-F.col("relative_abundance"), "target_mz", "isotope_id")
    best = t.near_of("true", None, "relative_abundance").groupBy("block", "sid", "ion_id").agg(F.min_by(F.struct("isotope_id", "intensity"), order).alias("b"))
    return best.select("sid", "ion_id", "b.*")


@query("orphan_matches_sample", "SELECT DISTINCT sid, ion_id FROM nearest WHERE ion_id NOT IN (SELECT ion_id FROM isotopes WHERE mechanism <> 3)", "nearest isotopes")
def _(t: Tables):
    return t.nearest.select("block", "sid", "ion_id").distinct().join(t.isotopes.where("mechanism <> 3").select("ion_id").hint("merge"), "ion_id", "left_anti").select("sid", "ion_id")


@query("remove_matches", "SELECT sid, isotope_id FROM nearest WHERE sid NOT IN (SELECT sid FROM samples WHERE batch_no < 5)", "nearest samples")
def _(t: Tables):
    return t.nearest.select("sid", "isotope_id").join(t.samples.where("batch_no < 5").select("sid"), "sid", "left_anti")


@query("incomplete_aggregates", "SELECT DISTINCT sid FROM nearest WHERE sid NOT IN (SELECT sid FROM ions WHERE category = 2)", "nearest ions")
def _(t: Tables):
    return t.nearest.select("sid").distinct().join(t.ions.where("category = 2").select("sid"), "sid", "left_anti")


@query(
    "best_match_per_ion",
    """SELECT i.ion_id, b.sid, round(b.score, 6) AS score FROM (SELECT DISTINCT ion_id FROM isotopes) i LEFT JOIN (
    SELECT ion_id, sid, score FROM (SELECT *, row_number() OVER (PARTITION BY ion_id ORDER BY round(score, 9) DESC, sid) AS rn FROM ions) WHERE rn = 1) b USING (ion_id)""",
    "isotopes ions",
)
def _(t: Tables):
    best = t.ions.groupBy("ion_id").agg(F.max_by(F.struct("sid", "score"), F.struct(F.round("score", 9), -F.col("sid"))).alias("b"))
    return t.isotopes.select("ion_id").distinct().join(best, "ion_id", "left").select("ion_id", "b.sid", F.round("b.score", 6).alias("score"))


@query(
    "peak_matches",
    """SELECT peak_id, string_agg(CAST(isotope_id AS VARCHAR), ',' ORDER BY isotope_id) AS isotopes, round(max(score), 6) AS best, count(DISTINCT collection_id) AS collections
    FROM gated WHERE found AND score > 0 GROUP BY peak_id""",
    "gated",
)
def _(t: Tables):
    g = t.gated.where("found AND score > 0").groupBy("peak_id")
    return g.agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("isotope_id")), lambda x: x.cast("string")), ",").alias("isotopes"),
        F.round(F.max("score"), 6).alias("best"), F.countDistinct("collection_id").alias("collections"),
    )


@query(
    "explode_matches",
    "SELECT p.peak_id, g.isotope_id FROM peaks p LEFT JOIN (SELECT peak_id, isotope_id FROM gated WHERE found AND score > 0) g USING (peak_id)",
    "peaks gated",
)
def _(t: Tables):
    lists = t.gated.where("found AND score > 0").groupBy("peak_id").agg(F.collect_list("isotope_id").alias("ids"))
    return t.peaks.select("peak_id").join(lists, "peak_id", "left").select("peak_id", F.explode_outer("ids").alias("isotope_id"))


@query("samples_mechanisms", "SELECT s.sid, m.mechanism FROM samples s, (VALUES (0), (1), (2), (3)) m(mechanism) WHERE m.mechanism % 2 = s.sid % 2", "samples")
def _(t: Tables):
    modes = F.when(F.col("sid") % 2 == 0, F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(1), F.lit(3)))
    return t.samples.select("sid", F.explode(modes).alias("mechanism"))


@query(
    "by_mass_window",
    "SELECT p.peak_id, i.ion_id FROM peaks p JOIN isotopes i ON p.mz BETWEEN i.mz - i.mz * 3e-6 AND i.mz + i.mz * 3e-6 WHERE i.k = 0",
    "peaks isotopes",
)
def _(t: Tables):
    i = t.isotopes.where("k = 0").select("ion_id", F.col("mz").alias("target_mz"))
    low, high = F.col("target_mz") - F.col("target_mz") * 3e-6, F.col("target_mz") + F.col("target_mz") * 3e-6
    return joins.range_join(t.peaks.select("peak_id", "mz"), i, low=low, high=high, ppm=3.0).select("peak_id", "ion_id")


@query(
    "annotate_formulas",
    "SELECT formula, count(DISTINCT compound_id) AS n_compounds, min(compound_name) AS first_name FROM isotopes WHERE k = 0 GROUP BY formula",
    "isotopes",
)
def _(t: Tables):
    return t.isotopes.where("k = 0").groupBy("formula").agg(F.countDistinct("compound_id").alias("n_compounds"), F.min("compound_name").alias("first_name"))


@query(
    "pair_by_position",
    """SELECT a.batch, a.sid AS reagent_sid, b.sid FROM (SELECT batch, sid, row_number() OVER (PARTITION BY batch ORDER BY sid) AS n FROM samples WHERE sid % 3 = 0) a
    JOIN (SELECT batch, sid, row_number() OVER (PARTITION BY batch ORDER BY sid) AS n FROM samples WHERE sid % 3 <> 0) b ON a.batch = b.batch AND a.n = b.n""",
    "samples",
)
def _(t: Tables):
    n = F.row_number().over(W.partitionBy("batch").orderBy("sid"))
    a = t.samples.where("sid % 3 = 0").select("batch", F.col("sid").alias("reagent_sid"), n.alias("n"))
    b = t.samples.where("sid % 3 <> 0").select("batch", "sid", n.alias("n"))
    return a.join(b, ["batch", "n"]).select("batch", "reagent_sid", "sid")


STAGES = [("warm", "2024-01-01", "2024-01-10"), ("steady", "2024-01-08", "2024-01-20"), ("late", "2024-01-22", "2024-01-28")]


@query(
    "interval_stage_join",
    """SELECT event_id, stage FROM scans LEFT JOIN (VALUES ('warm', TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-10'), ('steady', TIMESTAMP '2024-01-08', TIMESTAMP '2024-01-20'),
    ('late', TIMESTAMP '2024-01-22', TIMESTAMP '2024-01-28')) s(stage, a, b) ON ts >= a AND ts < b""",
    "scans",
)
def _(t: Tables):
    inside = F.filter(
        F.array(*(F.when((F.col("ts") >= F.lit(a).cast("timestamp")) & (F.col("ts") < F.lit(b).cast("timestamp")), F.lit(n)) for n, a, b in STAGES)), lambda x: x.isNotNull()
    )
    return t.scans.select("event_id", F.explode_outer(inside).alias("stage"))


@query(
    "golden_compare",
    """SELECT coalesce(g.peak_id, p.peak_id) AS peak_id, CASE WHEN p.peak_id IS NULL THEN 'missing' WHEN g.peak_id IS NULL THEN 'unexpected'
    WHEN abs(p.mz - g.mz) / g.mz * 1e6 > 0.1e0 OR abs(p.intensity - g.intensity) > 0.01e0 * g.intensity THEN 'differs' ELSE 'equal' END AS state
    FROM (SELECT peak_id, CASE WHEN snr > 45 THEN mz * 1.000001e0 ELSE mz END AS mz, intensity FROM peaks WHERE snr > 5) g
    FULL JOIN (SELECT * FROM peaks WHERE snr < 48) p USING (peak_id)""",
    "peaks",
)
def _(t: Tables):
    g = t.peaks.where("snr > 5").select("peak_id", F.when(F.col("snr") > 45, F.col("mz") * 1.000001).otherwise(F.col("mz")).alias("g_mz"), F.col("intensity").alias("g_intensity"))
    p = t.peaks.where("snr < 48").select("peak_id", "mz", "intensity")
    off = (F.abs(F.col("mz") - F.col("g_mz")) / F.col("g_mz") * 1e6 > 0.1) | (F.abs(F.col("intensity") - F.col("g_intensity")) > 0.01 * F.col("g_intensity"))
    state = F.when(F.col("mz").isNull(), "missing").when(F.col("g_mz").isNull(), "unexpected").when(off, "differs").otherwise("equal")
    return g.join(p, "peak_id", "full").select("peak_id", state.alias("state"))


@query(
    "upsert_matches",
    """SELECT coalesce(n.peak_id, o.peak_id) AS peak_id, coalesce(n.v, o.v) AS value, CASE WHEN o.peak_id IS NULL THEN 'created' WHEN n.peak_id IS NULL THEN 'kept'
    WHEN n.v IS DISTINCT FROM o.v THEN 'updated' ELSE 'unchanged' END AS change FROM (SELECT peak_id, intensity AS v FROM peaks WHERE snr <= 30) o
    FULL JOIN (SELECT peak_id, CASE WHEN snr = 25 THEN intensity + 1 ELSE intensity END AS v FROM peaks WHERE snr >= 20) n USING (peak_id)""",
    "peaks",
)
def _(t: Tables):
    o = t.peaks.where("snr <= 30").select("peak_id", F.col("intensity").alias("o"), F.lit(True).alias("was"))
    n = t.peaks.where("snr >= 20").select("peak_id", F.when(F.col("snr") == 25, F.col("intensity") + 1).otherwise(F.col("intensity")).alias("n"), F.lit(True).alias("now"))
    change = F.when(F.col("was").isNull(), "created").when(F.col("now").isNull(), "kept").when(~F.col("n").eqNullSafe(F.col("o")), "updated").otherwise("unchanged")
    return o.join(n, "peak_id", "full").select("peak_id", F.coalesce("n", "o").alias("value"), change.alias("change"))


@query("export_goldens_peaks", "SELECT s.sample_name, g.isotope_id, round(g.peak_mz, 6) AS mz, g.intensity, round(g.score, 6) AS score FROM gated g JOIN samples s USING (sid) WHERE g.score > 0", "gated samples")
def _(t: Tables):
    rows = t.gated.where("score > 0").join(t.samples.select("sid", "sample_name"), "sid").orderBy("sample_name", "isotope_id")
    return rows.select("sample_name", "isotope_id", F.round("peak_mz", 6).alias("mz"), "intensity", F.round("score", 6).alias("score"))


@query("export_goldens_ions", "SELECT s.sample_name, i.ion_id, round(i.score, 6) AS score FROM ions i JOIN samples s USING (sid) WHERE i.score > 0", "ions samples")
def _(t: Tables):
    return t.ions.where("score > 0").join(t.samples.select("sid", "sample_name"), "sid").orderBy("sample_name", "ion_id").select("sample_name", "ion_id", F.round("score", 6).alias("score"))


@query("export_batch_sheets", "SELECT s.batch, s.sample_name, i.compound_id, i.ion_id, i.category FROM ions i JOIN samples s USING (sid)", "ions samples")
def _(t: Tables):
    return t.ions.join(F.broadcast(t.samples.select("sid", "batch", "sample_name")), "sid").select("batch", "sample_name", "compound_id", "ion_id", "category")


@query("list_match_ions", "SELECT i.sid, i.ion_id, round(i.score, 6) AS score FROM ions i WHERE i.category >= 1 AND i.ion_id IN (SELECT ion_id FROM isotopes WHERE mechanism = 1)", "ions isotopes")
def _(t: Tables):
    m = t.isotopes.where("mechanism = 1").select("ion_id")
    return t.ions.where("category >= 1").join(m, "ion_id", "left_semi").select("sid", "ion_id", F.round("score", 6).alias("score"))


@query("list_match_isotopes", "SELECT sid, isotope_id, round(target_mz, 6) AS mz, round(score, 6) AS score FROM gated WHERE category >= 1", "gated")
def _(t: Tables):
    return t.gated.where("category >= 1").select("sid", "isotope_id", F.round("target_mz", 6).alias("mz"), F.round("score", 6).alias("score"))


@query("list_match_collections", "SELECT sid, collection_id, max(category) AS category FROM ions WHERE collection_type <> 'CALIBRANTS' GROUP BY sid, collection_id", "ions")
def _(t: Tables):
    return t.ions.where("collection_type <> 'CALIBRANTS'").groupBy("sid", "collection_id").agg(F.max("category").alias("category"))


@query("list_match_compounds", "SELECT sid, compound_id, max(category) AS category FROM ions GROUP BY sid, compound_id HAVING max(category) >= 1", "ions")
def _(t: Tables):
    return t.ions.groupBy("sid", "compound_id").agg(F.max("category").alias("category")).where("category >= 1")


@query("list_target_isotopes", "SELECT isotope_id, round(mz, 6) AS mz FROM isotopes WHERE mz BETWEEN 1e2 AND 3e2 AND relative_abundance >= 0.1e0", "isotopes")
def _(t: Tables):
    return t.isotopes.where("mz BETWEEN 1e2 AND 3e2 AND relative_abundance >= 0.1e0").select("isotope_id", F.round("mz", 6).alias("mz"))


@query("list_target_ions", "SELECT DISTINCT ion_id, collection_id FROM isotopes WHERE collection_type = 'TARGETS' AND mechanism IN (0, 2)", "isotopes")
def _(t: Tables):
    return t.isotopes.where("collection_type = 'TARGETS' AND mechanism IN (0, 2)").select("ion_id", "collection_id").distinct()


@query("list_target_compounds", "SELECT compound_id, min(compound_name) AS name FROM isotopes WHERE contains(compound_name, 'r') GROUP BY compound_id", "isotopes")
def _(t: Tables):
    return t.isotopes.where(F.col("compound_name").contains("r")).groupBy("compound_id").agg(F.min("compound_name").alias("name"))


@query("list_target_collections", "SELECT collection_id, collection_type, count(DISTINCT compound_id) AS n FROM isotopes GROUP BY collection_id, collection_type", "isotopes")
def _(t: Tables):
    return t.isotopes.groupBy("collection_id", "collection_type").agg(F.countDistinct("compound_id").alias("n"))


@query("samples_for_ion", "SELECT DISTINCT n.ion_id, n.sid FROM samples s JOIN nearest n USING (sid) WHERE s.instrument = 'tof'", "samples nearest")
def _(t: Tables):
    some = t.samples.where("instrument = 'tof'").select("sid")
    return t.nearest.select("block", "ion_id", "sid").distinct().join(F.broadcast(some), "sid", "left_semi").select("ion_id", "sid")


@query("affected_samples", "SELECT f.file_id, s.sid, s.batch FROM files f JOIN samples s USING (sid) WHERE f.status = 'P'", "files samples")
def _(t: Tables):
    return t.files.where("status = 'P'").join(t.samples.select("sid", "batch"), "sid").select("file_id", "sid", "batch")


@query("latest_mz_calibration", "SELECT type, max(created) AS created, max(file_id) AS file_id FROM (SELECT *, rank() OVER (PARTITION BY type ORDER BY created DESC) AS r FROM files WHERE status <> 'O') WHERE r = 1 GROUP BY type", "files")
def _(t: Tables):
    return t.files.where("status <> 'O'").groupBy("type").agg(F.max(F.struct("created", "file_id")).alias("b")).select("type", "b.*")


@query("assignment_runs", "SELECT sid, file_id, row_number() OVER (PARTITION BY sid ORDER BY created DESC, file_id DESC) AS n FROM files", "files")
def _(t: Tables):
    return t.files.select("sid", "file_id", F.row_number().over(W.partitionBy("sid").orderBy(F.desc("created"), F.desc("file_id"))).alias("n"))


@query(
    "prune_runs",
    """SELECT file_id FROM (SELECT *, row_number() OVER (PARTITION BY sid, status = 'F' ORDER BY created DESC NULLS LAST, file_id DESC) AS n FROM files)
    WHERE (status = 'F' AND n > 3) OR (status = 'O' AND created < TIMESTAMP '1998-01-01') OR (status = 'P' AND created < TIMESTAMP '1997-12-30')""",
    "files",
)
def _(t: Tables):
    n = F.row_number().over(W.partitionBy("sid", F.col("status") == "F").orderBy(F.desc_nulls_last("created"), F.desc("file_id")))
    old = "(status = 'F' AND n > 3) OR (status = 'O' AND created < TIMESTAMP '1998-01-01') OR (status = 'P' AND created < TIMESTAMP '1997-12-30')"
    return t.files.withColumn("n", n).where(old).select("file_id")


@query("reset_stale_runs", "SELECT file_id, CASE WHEN status = 'P' THEN 'failed' ELSE status END AS status FROM files", "files")
def _(t: Tables):
    return t.files.select("file_id", F.when(F.col("status") == "P", "failed").otherwise(F.col("status")).alias("status"))


@query("filter_assignments", "SELECT file_id, sid, tic FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY created DESC, file_id DESC) AS n FROM files WHERE status = 'F') WHERE n = 1", "files")
def _(t: Tables):
    return t.files.where("status = 'F'").groupBy("sid").agg(F.max_by(F.struct("file_id", "tic"), F.struct("created", "file_id")).alias("b")).select("b.file_id", "sid", "b.tic")


@query("page_sorted_matches", "SELECT sid, ion_id, n FROM (SELECT sid, ion_id, row_number() OVER (PARTITION BY sid ORDER BY collection_id, coalesce(category, -1) DESC, round(score, 9) DESC, ion_id) AS n FROM ions) WHERE n BETWEEN 11 AND 20", "ions")
def _(t: Tables):
    w = W.partitionBy("sid").orderBy("collection_id", F.desc(F.coalesce("category", F.lit(-1))), F.desc(F.round("score", 9)), "ion_id")
    return t.ions.withColumn("n", F.row_number().over(w)).where("n BETWEEN 11 AND 20").select("sid", "ion_id", "n")


@query("untargeted_topk", "SELECT sid, peak_id, n FROM (SELECT sid, peak_id, row_number() OVER (PARTITION BY sid ORDER BY intensity DESC, mz, peak_id) AS n FROM peaks) WHERE n <= 10", "peaks")
def _(t: Tables):
    n = F.row_number().over(W.partitionBy("sid").orderBy(F.desc("intensity"), "mz", "peak_id"))
    return t.peaks.withColumn("n", n).where("n <= 10").select("sid", "peak_id", "n")


@query("union_polarities", "SELECT sid, peak_id, polarity FROM peaks WHERE polarity = '+' UNION ALL SELECT sid, peak_id, polarity FROM peaks WHERE polarity = '-'", "peaks")
def _(t: Tables):
    p = t.peaks.select("sid", "peak_id", "polarity")
    return p.where("polarity = '+'").unionByName(p.where("polarity = '-'"))


@query("union_known_isotopes", "SELECT isotope_id, collection_id, NULL AS source FROM isotopes WHERE k = 0 UNION ALL SELECT isotope_id, NULL, 'known' FROM isotopes WHERE k = 1", "isotopes")
def _(t: Tables):
    a = t.isotopes.where("k = 0").select("isotope_id", "collection_id")
    b = t.isotopes.where("k = 1").select("isotope_id", F.lit("known").alias("source"))
    return a.unionByName(b, allowMissingColumns=True)


@query(
    "collapse_by_inchikey",
    """WITH x AS (SELECT formula, md5(concat(formula, CAST(compound_id % 3 AS VARCHAR))) AS key, collection_id AS source, CASE WHEN compound_id % 5 = 0 THEN NULL ELSE compound_name END AS name, isotope_id AS id FROM isotopes WHERE k = 0)
    SELECT key, min(formula) AS formula, arg_min(name, {'s': source, 'i': id}) FILTER (WHERE name IS NOT NULL) AS name, arg_min(id, {'s': source, 'i': id}) AS id, count(DISTINCT source) AS sources FROM x GROUP BY key""",
    "isotopes",
)
def _(t: Tables):
    key = F.md5(F.concat("formula", (F.col("compound_id") % 3).cast("string")))
    x = t.isotopes.where("k = 0").select("formula", key.alias("key"), F.col("collection_id").alias("source"), F.when(F.col("compound_id") % 5 != 0, F.col("compound_name")).alias("name"), F.col("isotope_id").alias("id"))
    rank = F.struct("source", "id")
    return x.groupBy("key").agg(
        F.min("formula").alias("formula"), F.min_by("name", F.when(F.col("name").isNotNull(), rank)).alias("name"), F.min_by("id", rank).alias("id"), F.countDistinct("source").alias("sources")
    )
