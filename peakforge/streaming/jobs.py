"""Structured Streaming jobs on the events stream; each has the batch form of its result as its check."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """New files of a table in a folder as a stream, with the columns that the files there have."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("ignoreCorruptFiles", "false").option("pathGlobFilter", f"{name}*.parquet").parquet(folder)


def events(spark: SparkSession, folder: str) -> DataFrame:
    """New files of events in a folder as a stream; a file that cannot be read is retried by its task, then fails the query, uncommitted."""
    rows = spark.readStream.schema(EVENTS).option("ignoreCorruptFiles", "false").option("pathGlobFilter", "events*.parquet").parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session or of its context.

    A temporary one is made only where none is set and the master is local, as in tests; a cluster has to name its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there and its size is known."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_available(stream: DataFrame, *, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return what its sink holds. A finished append is exactly-once Parquet."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex[:12]}"
    stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def run_appends(stream: DataFrame, schema: str, make: Callable[[DataFrame, DataFrame], DataFrame], base: str | None = None) -> DataFrame:
    """Run a stream through ``foreachBatch``: ``make(earlier, batch)`` gives the rows that a batch adds to a table of deltas.

    Each batch has a folder of its own under the table, named by its number: nothing that is there is rewritten, a batch that is run again
    replaces its own rows only, and a restart finds all it needs in the folder.
    """
    spark = stream.sparkSession
    base = base or f"{shared_folder(spark)}/deltas-{uuid.uuid4().hex[:12]}"
    table = lambda s: s.read.schema(f"{schema}, batch bigint").option("basePath", f"{base}/table").parquet(f"{base}/table")
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{base}/table/batch=-1")

    def step(batch: DataFrame, number: int) -> None:
        earlier = table(batch.sparkSession).where(F.col("batch") < number).drop("batch")
        make(earlier, batch).write.mode("overwrite").parquet(f"{base}/table/batch={number}")

    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return table(spark).drop("batch")


class Ingest:
    """Files of a folder taken into a table, each by itself: one that cannot be read is put aside with its error and tried again by a later run.

    The stream is one of file names, at most ``per_batch`` in a batch; rows are read by Spark. A batch's files are read together; if that fails they are
    halved until the bad ones stand alone, so the others of the batch are not lost and a clean batch is one job. What is read goes to a new folder, and
    the log of the batch, written last, names it: rows count only once the log says so, and a batch that is run again is logged again as a whole.
    ``run`` first tries the files put aside, up to ``most`` times each.
    """

    LOG = "path string, status string, error string, piece string, attempt int, run string"

    def __init__(self, spark: SparkSession, folder: str, pattern: str, schema: str, base: str | None = None, *, per_batch: int = 200, most: int = 3) -> None:
        self.spark, self.folder, self.pattern, self.schema, self.per_batch, self.most = spark, folder, pattern, schema, per_batch, most
        self.base = base or f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex[:12]}"
        spark.createDataFrame([], self.LOG).write.mode("ignore").parquet(f"{self.base}/log/batch=none")

    def log(self) -> DataFrame:
        """(path, status, error, piece, attempt, run) of every file and attempt."""
        return self.spark.read.schema(f"{self.LOG}, batch string").option("basePath", f"{self.base}/log").parquet(f"{self.base}/log")

    def quarantine(self) -> DataFrame:
        """(path, error, attempt) of the files whose last attempt failed."""
        last = self.log().groupBy("path").agg(F.max_by(F.struct("status", "error", "attempt"), "attempt").alias("l")).select("path", "l.*")
        return last.where("status = 'failed'").select("path", "error", "attempt")

    def rows(self) -> DataFrame:
        """What has been taken in."""
        pieces = [r["piece"] for r in self.log().where("status = 'read'").select("piece").distinct().collect()]  # a name for each batch, or each part of one with bad files
        return self.spark.read.schema(self.schema).parquet(*pieces) if pieces else self.spark.createDataFrame([], self.schema)

    def take(self, paths: list[str]) -> list[tuple[str, str, str | None, str | None]]:
        """(path, status, error, piece) for each of ``paths``."""
        if not paths:
            return []
        piece = f"{self.base}/rows/{uuid.uuid4().hex}"
        try:
            self.spark.read.schema(self.schema).option("ignoreCorruptFiles", "false").parquet(*paths).write.parquet(piece)
        except (PySparkException, Py4JJavaError) as error:  # a task found a file that cannot be read, or it is gone
            if len(paths) == 1:
                return [(paths[0], "failed", str(error)[:2000], None)]
            half = len(paths) // 2
            return self.take(paths[:half]) + self.take(paths[half:])
        return [(p, "read", None, piece) for p in paths]

    def logged(self, taken: list[tuple], attempts: dict[str, int], batch: str) -> None:
        rows = [(*t, attempts.get(t[0], 0) + 1, batch) for t in taken]
        self.spark.createDataFrame(rows, self.LOG).write.mode("overwrite").parquet(f"{self.base}/log/batch={batch}")

    def run(self) -> None:
        """Try what was put aside, then take in the files that are new."""
        again = {r["path"]: r["attempt"] for r in self.quarantine().where(F.col("attempt") < self.most).collect()}
        if again:
            self.logged(self.take(sorted(again)), again, f"again-{uuid.uuid4().hex}")
        names = "path string, modificationTime timestamp, length bigint, content binary"
        files = self.spark.readStream.format("binaryFile").schema(names).option("pathGlobFilter", self.pattern).option("maxFilesPerTrigger", self.per_batch).load(self.folder).select("path")

        def step(batch: DataFrame, number: int) -> None:
            self.logged(self.take(sorted(r["path"] for r in batch.collect())), {}, f"new-{number}")  # at most per_batch names

        files.writeStream.foreachBatch(step).option("checkpointLocation", f"{self.base}/state").trigger(availableNow=True).start().awaitTermination()


def retries(rows: DataFrame, *, limit: float = 20.0, most: int = 3) -> DataFrame:
    """(user_id, failures, status, last_at) of each user whose attempts a batch adds to: ``failed`` for good after ``most`` failures in a row.

    An attempt fails if its value is above ``limit``; a success starts the count anew. The count is the state of a user.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, done = state.get if state.exists else (0, False)
        seen = pd.concat(batches).sort_values(["ts", "event_id"])
        for value in seen["value"]:
            failures = failures if done else (failures + 1 if value > limit else 0)
            done = done or failures >= most
        state.update((failures, done))
        yield pd.DataFrame({"user_id": [key[0]], "failures": [failures], "status": ["failed" if done else "open"], "last_at": [seen["ts"].max()]})

    out = "user_id bigint, failures bigint, status string, last_at timestamp"
    return rows.groupBy("user_id").applyInPandasWithState(step, out, "failures bigint, done boolean", "append", GroupStateTimeout.NoTimeout)


def tumbling(rows: DataFrame, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    w = rows.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(rows: DataFrame, size: str = "2 hours", step: str = "1 hour", late: str = "1 day") -> DataFrame:
    w = rows.withWatermark("ts", late).groupBy(F.window("ts", size, step).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(rows: DataFrame, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    w = rows.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return w.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
