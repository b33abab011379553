"""Reference compounds from delimited and molecule files, and their versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: fixed aliases of the columns of a common record
ALIASES = {
    "formula": ("formula", "molecular_formula", "molecular formula"),
    "name": ("name", "preferred_name", "compound name", "title"),
    "native_id": ("native_id", "id", "identifier", "accession"),
}


def normal(name: str) -> str:
    """A header without byte-order mark, spaces around and capitals."""
    return name.replace("﻿", "").strip().lower()


def read_delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Rows of delimited files with a header as common records; blank values are nulls, the first filled alias counts."""
    rows = spark.read.option("header", True).option("sep", sep).csv(path)
    names = {normal(c): c for c in rows.columns}
    value = lambda aliases: [F.nullif(F.trim(F.col(f"`{names[a]}`")), F.lit("")) for a in aliases if a in names]
    pick = {k: value(a) for k, a in ALIASES.items()}
    return rows.select(*((F.coalesce(*v) if v else F.lit(None).cast("string")).alias(k) for k, v in pick.items()))


def read_sdf(spark: SparkSession, path: str) -> DataFrame:
    """Records of molecule files as maps of their data fields; what follows the last separator is no record."""
    text = spark.read.option("lineSep", "$$$$\n").text(path)
    field, val = F.regexp_extract_all("value", F.lit(r"(?m)^> *<([^>]+)>.*\n(.*)$"), F.lit(1)), F.regexp_extract_all("value", F.lit(r"(?m)^> *<([^>]+)>.*\n(.*)$"), F.lit(2))
    rows = text.where(F.trim(F.col("value")) != "").select(field.alias("f"), val.alias("v"))
    # of a field that is repeated the first value counts
    return rows.select(F.map_from_arrays(F.array_distinct("f"), F.transform(F.array_distinct("f"), lambda x: F.get("v", F.array_position("f", x).cast("int") - 1))).alias("fields"))


def read_xml(spark: SparkSession, path: str, fields: tuple[str, ...] = ("accession", "name", "chemical_formula"), row: str = "metabolite") -> DataFrame:
    """The named children of every ``row`` element; name-space prefixes count for nothing, blank and missing ones are nulls."""
    schema = ", ".join(f"`{c}` string" for c in fields)
    rows = spark.read.format("xml").option("rowTag", row).option("ignoreNamespace", "true").schema(schema).load(path)
    return rows.select(*(F.nullif(F.trim(F.col(c)), F.lit("")).alias(c) for c in fields))


def read_sidecar(spark: SparkSession, path: str, *, key: str = "sid", time: str = "ts") -> DataFrame:
    """(key, time, sensor, value) of wide sensor files with a header: one row for each sensor that has a number."""
    rows = spark.read.option("header", True).csv(path)
    sensors = [c for c in rows.columns if c not in (key, time)]
    long = rows.unpivot([key, time], sensors, "sensor", "value")
    return long.select(F.col(key).cast("long").alias(key), F.to_timestamp(time).alias(time), F.trim("sensor").alias("sensor"), F.expr("try_cast(value AS DOUBLE)").alias("value")).where("value IS NOT NULL")


MANIFEST = "source string, version string, n bigint, number bigint, ingested timestamp"


def manifest(spark: SparkSession, base: str) -> DataFrame:
    """Every version that was made active, the one of the highest number of a source last."""
    spark.createDataFrame([], MANIFEST).write.mode("ignore").parquet(f"{base}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{base}/manifest")


def active(spark: SparkSession, base: str) -> DataFrame:
    """(source, version, n, ingested) of the version of each source that counts now: with its time, what known lists are told apart by."""
    last = manifest(spark, base).groupBy("source").agg(F.max_by(F.struct("version", "n", "ingested"), "number").alias("l"))
    return last.select("source", "l.*")


def ingest_version(rows: DataFrame, base: str, source: str, version: str) -> DataFrame:
    """Write a version of a source and make it the active one; a load without rows is refused before that.

    The manifest is only added to, one line after the rows are in place, and the highest line of a source counts: a reader sees the old version or the new.
    """
    spark, path = rows.sparkSession, f"{base}/source={source}/version={version}"
    rows.write.mode("overwrite").parquet(path)
    n = spark.read.schema(rows.schema).parquet(path).count()
    if not n:
        raise ValueError(f"{source} {version} has no usable rows")
    number = (manifest(spark, base).where(F.col("source") == source).agg(F.max("number")).first()[0] or 0) + 1
    line = spark.createDataFrame([(source, version, n, number)], "source string, version string, n bigint, number bigint").withColumn("ingested", F.current_timestamp())
    line.write.mode("append").parquet(f"{base}/manifest")
    return active(spark, base).where(F.col("source") == source).select("source", "version", "n")


def read_active(spark: SparkSession, base: str, source: str, schema: str) -> DataFrame:
    """The rows of the active version of a source."""
    version = active(spark, base).where(F.col("source") == source).first()["version"]
    return spark.read.schema(schema).parquet(f"{base}/source={source}/version={version}")
