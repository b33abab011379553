"""Queries on reference files: written from the tables first, then read as any such file is."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from peakforge.operators.joins import asof_nearest
from peakforge.plans.registry import query
from peakforge.sources import reference
from peakforge.sources.fixtures import Tables
from peakforge.streaming.jobs import shared_folder


def folder(t: Tables) -> str:
    return f"{shared_folder(t.spark)}/reference-{uuid.uuid4().hex[:12]}"


@query("read_reference_delimited", "SELECT formula, CASE WHEN k = 1 THEN NULL ELSE compound_name END AS name, CAST(isotope_id AS VARCHAR) AS native_id FROM isotopes", "isotopes")
def _(t: Tables):
    path = folder(t)
    name = F.when(F.col("k") == 1, F.lit("  ")).otherwise(F.col("compound_name"))
    rows = t.isotopes.select(F.col("formula").alias(" Molecular_Formula "), name.alias("Preferred_Name"), F.col("isotope_id").alias("﻿ID"))
    rows.write.option("header", True).csv(path)
    return reference.read_delimited(t.spark, path)


@query("read_reference_sdf", "SELECT CAST(isotope_id AS VARCHAR) AS id, formula FROM isotopes WHERE k = 0", "isotopes")
def _(t: Tables):
    path = folder(t)
    body = F.concat(F.lit("mol\n> <ID>\n"), F.col("isotope_id"), F.lit("\n\n> <FORMULA>\n"), F.col("formula"), F.lit("\n\n$$$$"))
    t.isotopes.where("k = 0").select(body.alias("value")).write.text(path)
    return reference.read_sdf(t.spark, path).select(F.col("fields")["ID"].alias("id"), F.col("fields")["FORMULA"].alias("formula"))


@query("ingest_reference_version", "SELECT 'library' AS source, 'v2' AS version, count(DISTINCT formula) AS n FROM isotopes", "isotopes")
def _(t: Tables):
    base = folder(t)
    reference.ingest_version(t.isotopes.where("k = 0").select("formula").distinct(), base, "library", "v1")
    return reference.ingest_version(t.isotopes.select("formula").distinct(), base, "library", "v2")


@query(
    "known_fingerprint",
    """SELECT collection_type AS source, CASE collection_type WHEN 'TARGETS' THEN 'v2' ELSE 'v1' END AS version, count(*) FILTER (collection_type <> 'TARGETS' OR k = 0) AS n, true AS dated FROM isotopes GROUP BY collection_type""",
    "isotopes",
)
def _(t: Tables):
    """The active version of each source of known compounds, of which one was loaded a second time."""
    base = folder(t)
    for source in ("TARGETS", "DIAGNOSTICS", "CALIBRANTS"):
        reference.ingest_version(t.isotopes.where(F.col("collection_type") == source).select("isotope_id", "formula"), base, source, "v1")
    reference.ingest_version(t.isotopes.where("collection_type = 'TARGETS' AND k = 0").select("isotope_id", "formula"), base, "TARGETS", "v2")
    return reference.active(t.spark, base).select("source", "version", "n", F.col("ingested").isNotNull().alias("dated"))


@query("read_reference_xml", "SELECT CAST(p_partkey AS VARCHAR) AS accession, p_name AS name, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'C' || p_size || 'H4' END AS chemical_formula FROM part")
def _(t: Tables):
    path = folder(t)
    text = F.when(F.col("p_partkey") % 5 == 0, F.lit(" ")).otherwise(F.concat(F.lit("C"), F.col("p_size").cast("string"), F.lit("H4")))
    rows = t.raw("part").select(F.col("p_partkey").cast("string").alias("accession"), F.col("p_name").alias("name"), text.alias("chemical_formula"))
    rows.write.format("xml").option("rootTag", "hmdb").option("rowTag", "metabolite").save(path)
    return reference.read_xml(t.spark, path)


@query(
    "read_sidecar_timeseries",
    """WITH s AS (SELECT user_id AS sid, ts, max(value) AS v FROM events WHERE event_type = 'view' GROUP BY ALL), q AS (SELECT DISTINCT user_id AS sid, ts AS asked FROM events WHERE event_type = 'purchase'),
    l AS (SELECT sid, ts, 'temperature' AS sensor, v AS value FROM s UNION ALL SELECT sid, ts, 'pressure', 2 * v FROM s WHERE v <= 20),
    c AS (SELECT q.sid, q.asked, l.sensor, l.value, row_number() OVER (PARTITION BY q.sid, q.asked, l.sensor ORDER BY abs(epoch_us(l.ts) - epoch_us(q.asked)), l.ts) AS n FROM q JOIN l USING (sid))
    SELECT sid, asked, sensor, round(value, 4) AS value FROM c WHERE n = 1""",
)
def _(t: Tables):
    path = folder(t)
    wide = t.scans.where("ion = 'view'").groupBy("sid", "ts").agg(F.max("height").alias("temperature"))
    wide = wide.select("sid", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "temperature", F.when(F.col("temperature") > 20, "n/a").otherwise((2 * F.col("temperature")).cast("string")).alias("pressure"))
    wide.write.option("header", True).csv(path)
    long = reference.read_sidecar(t.spark, path)
    asked = t.scans.where("ion = 'purchase'").select("sid", F.col("ts").alias("asked")).distinct()
    sensors = long.select("sid", "sensor").distinct()
    asks = asked.join(sensors, "sid").select(F.struct("sid", "sensor").alias("key"), "asked")
    values = long.select(F.struct("sid", "sensor").alias("key"), F.col("ts").alias("asked"), "value")
    near = asof_nearest(asks, values, key="key", time="asked", value="value").where("scan_time IS NOT NULL")
    return near.select("key.sid", "asked", "key.sensor", F.round("value", 4).alias("value"))
