"""Fragment spectra: clusters of parents, averaged centroids of each, and what the fragments say about them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from peakforge.operators.signal import gap_bin

#: fixed values of the classification: share of the total that a fragment needs, tolerance of its m/z in Da
MIN_SHARE, TOLERANCE = 0.01, 0.01
PARENT_GAP = 1e-3  # Da between two parents


def with_parent(rows: DataFrame) -> DataFrame:
    """``rows`` (sid, scan, parent_mz, ...) with the number of their parent's cluster: a gap of 1 mDa starts a new one.

    Clusters are found on the distinct parent m/z of a recording and joined back, so fragments are not sorted by them.
    """
    known = rows.select("sid", "parent_mz").distinct()
    w = W.partitionBy("sid").orderBy("parent_mz")
    fresh = F.when(F.col("parent_mz") - F.lag("parent_mz").over(w) > PARENT_GAP, 1).otherwise(0)
    known = known.withColumn("fresh", fresh).withColumn("parent", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("fresh")
    return rows.join(known, ["sid", "parent_mz"])


def parents(rows: DataFrame) -> DataFrame:
    """(sid, parent, mz, scans) of each parent: the median of its m/z over its scans."""
    per = rows.select("sid", "parent", "scan", "parent_mz").distinct()
    return per.groupBy("sid", "parent").agg(F.median("parent_mz").alias("parent_mz"), F.count("*").alias("scans"))


def centroids(rows: DataFrame, *, ppm: float = 20.0, min_snr: float = 3.0) -> DataFrame:
    """Averaged centroids of each parent: peaks within ``ppm`` gaps, weighted m/z, intensity per scan of the parent."""
    good = gap_bin(rows.where(F.col("snr") >= min_snr), ppm=ppm, keys=("sid", "parent"))
    per = good.groupBy("sid", "parent", "bin").agg((F.sum(F.col("mz") * F.col("intensity")) / F.sum("intensity")).alias("mz"), F.sum("intensity").alias("total"), F.count("*").alias("n_peaks"))
    return per.join(parents(rows), ["sid", "parent"]).select("sid", "parent", "parent_mz", "scans", "bin", "mz", (F.col("total") / F.col("scans")).alias("intensity"), "n_peaks")


def looked_up(spectra: DataFrame, **targets) -> DataFrame:
    """Per parent its total and, for each name, the nearest centroid to a target m/z (a column): one pass, no join."""
    near = {k: F.min_by(F.struct("mz", "intensity"), F.struct(F.abs(F.col("mz") - v), "mz")).alias(k) for k, v in targets.items()}
    return spectra.groupBy("sid", "parent", "parent_mz").agg(F.sum("intensity").alias("tic"), *near.values())


def classify(found: DataFrame, reagent_mz: float, transfer_mass: float) -> DataFrame:
    """Adds type, and intensities of the reagent ion and of the analyte fragment, 0 where none is near enough."""
    hit = lambda c, at: F.when(F.abs(F.col(f"{c}.mz") - at) < TOLERANCE, F.col(f"{c}.intensity")).otherwise(0.0)
    rows = found.withColumns({"reagent_intensity": hit("reagent", F.lit(reagent_mz)), "analyte_intensity": hit("analyte", F.col("parent_mz") - transfer_mass)})
    least = F.col("tic") * MIN_SHARE
    kind = F.when((F.col("reagent_intensity") < least) & (F.col("analyte_intensity") < least), "Undetermined").when(F.col("reagent_intensity") >= F.col("analyte_intensity"), "Declustering")
    return rows.where("tic > 0").withColumn("type", kind.otherwise("Proton transfer"))
