"""Verdicts of users on assignments: appended with a snapshot of what was judged, never changed, read back newest first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakforge.operators import scan
from peakforge.streaming.jobs import shared_folder

SCHEMA = "assignment bigint, verdict string, evidence_level string, fit_score double, evidence double, p_correct double"


class Verdicts:
    """A folder of verdicts. Each append is a folder of its own, numbered; one that is written again replaces itself alone."""

    def __init__(self, spark: SparkSession, base: str | None = None) -> None:
        self.spark, self.base = spark, base or f"{shared_folder(spark)}/verdicts-{uuid.uuid4().hex[:12]}"
        spark.createDataFrame([], SCHEMA).write.mode("ignore").parquet(f"{self.base}/append=-1")

    def record(self, verdicts: DataFrame, assignments: DataFrame, append: int) -> None:
        """Append (assignment, verdict, evidence_level) with the scores that ``assignments`` (assignment, fit_score, evidence, p_correct) hold now.

        Verdicts on assignments that are not there are refused; a confirmation names its evidence.
        """
        told = verdicts.join(assignments, "assignment", "left")
        bad = F.col("fit_score").isNull() | ~F.col("verdict").isin("confirmed", "rejected", "unsure") | ((F.col("verdict") == "confirmed") & F.col("evidence_level").isNull())
        if not (wrong := told.where(bad)).isEmpty():
            raise ValueError(f"verdict cannot be recorded: {wrong.first().asDict()}")
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        told.select(*(F.col(n).cast(c.split()[1]) for n, c in zip(names, SCHEMA.split(", "), strict=True))).write.mode("overwrite").parquet(f"{self.base}/append={append}")

    def all(self) -> DataFrame:
        """Every verdict with the number of its append."""
        return self.spark.read.schema(f"{SCHEMA}, append int").option("basePath", self.base).parquet(self.base)

    def newest_first(self, groups: DataFrame, key: str) -> DataFrame:
        """Verdicts with their place among those of the same ``key`` of ``groups`` (assignment, key), the newest first."""
        rows = self.all().join(groups, "assignment").withColumns({"_a": -F.col("append"), "_i": -F.col("assignment")})
        place = {"keys": (key,), "order": ("_a", "_i")}
        return scan.running(scan.ranged(rows, **place), {"place": F.lit(1)}, **place).drop("_a", "_i", scan.PART)
