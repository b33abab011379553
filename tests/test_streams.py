"""Streams over several batches: nothing is lost or passed over, and what they hold is the result of one batch."""

import itertools

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from peakforge.operators.joins import nearest_peak
from peakforge.plans import registry
from peakforge.plans.streams import drift_alerts, match_batches
from peakforge.sources.fixtures import Tables
from peakforge.streaming import jobs

QUERIES = registry.QUERIES


def some_events(spark, sf_dir, path, rows):
    frame = spark.read.parquet(f"{sf_dir}/events.parquet").where(f"event_id >= {rows[0]} AND event_id < {rows[1]}").toPandas()
    frame.astype({"ts": "datetime64[us]"}).to_parquet(path)
    return set(frame["event_id"])


def test_an_unreadable_file_fails_a_plain_stream(spark, sf_dir, tmp_path):
    some_events(spark, sf_dir, tmp_path / "events-1.parquet", (0, 20))
    assert jobs.run_available(jobs.events(spark, str(tmp_path))).count() > 0
    (tmp_path / "events-2.parquet").write_bytes(b"PAR1 cut off")
    with pytest.raises(StreamingQueryException):
        jobs.run_available(jobs.events(spark, str(tmp_path)))


def test_ingest_puts_bad_files_aside_and_tries_them_again(spark, sf_dir, tmp_path):
    files, base = tmp_path / "in", f"file://{tmp_path}/base"
    files.mkdir()
    good = some_events(spark, sf_dir, files / "events-1.parquet", (0, 20)) | some_events(spark, sf_dir, files / "events-3.parquet", (20, 50))
    (files / "events-2.parquet").write_bytes(b"PAR1 cut off")
    (files / "other.parquet").write_bytes(b"not looked at")
    ids = lambda i: sorted(r["event_id"] for r in i.rows().select("event_id").collect())
    ingest = jobs.Ingest(spark, str(files), "events*.parquet", jobs.EVENTS, base)
    ingest.run()
    assert ids(ingest) == sorted(good)
    bad = ingest.quarantine().collect()
    assert len(bad) == 1 and bad[0]["path"].endswith("events-2.parquet") and bad[0]["error"] and bad[0]["attempt"] == 1
    # a later run, from the folder alone: still bad, then mended, with a new file beside it
    jobs.Ingest(spark, str(files), "events*.parquet", jobs.EVENTS, base).run()
    assert ingest.quarantine().first()["attempt"] == 2
    good |= some_events(spark, sf_dir, files / "events-2.parquet", (50, 60)) | some_events(spark, sf_dir, files / "events-4.parquet", (60, 70))
    ingest = jobs.Ingest(spark, str(files), "events*.parquet", jobs.EVENTS, base)
    ingest.run()
    assert ids(ingest) == sorted(good) and ingest.quarantine().count() == 0
    ingest.run()
    assert ids(ingest) == sorted(good)


def test_ingest_gives_up_after_some_attempts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "events-1.parquet").write_bytes(b"no")
    ingest = jobs.Ingest(spark, f"{tmp_path}/in", "events*.parquet", jobs.EVENTS, f"file://{tmp_path}/base", most=2)
    for _ in range(4):
        ingest.run()
    assert ingest.quarantine().first()["attempt"] == 2 and ingest.rows().count() == 0


def batches(spark, sf_dir, tmp_path, order):
    """The line items as a stream of three batches, dealt by position, in an order of their files' times."""
    import os

    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").toPandas()
    for place, k in enumerate(order):
        path = tmp_path / f"lineitem-{k}.parquet"
        part = rows.iloc[k::3]
        part.astype({c: "datetime64[us]" for c in part.columns if str(part[c].dtype).startswith("datetime")}).to_parquet(path)
        os.utime(path, (10**9 + place * 100,) * 2)
    schema = spark.read.parquet(f"{sf_dir}/lineitem.parquet").schema
    return Tables.peaks_of(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "lineitem*.parquet").parquet(str(tmp_path)))


@pytest.mark.parametrize("order", list(itertools.permutations(range(3)))[::2])
def test_matches_and_drift_do_not_depend_on_batches(spark, sf_dir, tmp_path, order):
    t = Tables(spark, sf_dir)
    stream = batches(spark, sf_dir, tmp_path, order)
    got = match_batches(stream, t.isotopes)
    want = nearest_peak(t.peaks, t.isotopes, key="sid", target="isotope_id", window=0.5)
    key = lambda df: sorted((r["sid"], r["isotope_id"], r["peak_id"], round(r["mz"], 6), r["intensity"]) for r in df.collect())
    assert key(got) == key(want)
    calibrants = t.isotopes.where("collection_type = 'CALIBRANTS' AND k = 0").select(F.col("mz").alias("target_mz"))
    alerts = [(r["sid"], r["instrument"], r["n"], round(r["drift"], 6)) for r in drift_alerts(stream, calibrants, t.samples).collect()]
    assert len({a[0] for a in alerts}) == len(alerts)
    assert sorted(alerts) == sorted(tuple(r) for r in QUERIES["stream_drift_alert"](spark, sf_dir).select("sid", "instrument", "n", "drift").collect())


def test_sessions_are_found_by_the_stream(spark, sf_dir):
    found = QUERIES["stream_session"](spark, sf_dir)
    plan = found._jdf.queryExecution().toString()
    assert "Window" not in plan  # sessions are read from the sink
