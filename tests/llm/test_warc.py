import gzip
import hashlib
import io
import re

import pytest

from peakforge.llm import warc


def record(i, payload, ref=None):
    return warc.encode_record(i, f"http://x/{i}\r\nEvil: 1", payload, hashlib.sha256(payload).hexdigest(), len(payload), ref)


def test_round_trip_in_small_reads():
    class Drip(io.RawIOBase):
        def __init__(self, data):
            self.inner = io.BytesIO(data)

        def read(self, n=-1):
            return self.inner.read(min(n, 7))

    payloads = [b"", b"\r\n\r\n" * 50, bytes(range(256)) * 900, "naïve — 🙂".encode()]
    data = b"".join(record(i, p) for i, p in enumerate(payloads)) + record(9, payloads[2], 2)
    got = list(warc.read_records(Drip(data), with_payload=True))
    assert [r["payload"] for r in got] == [*payloads, None]
    assert got[-1]["record_type"] == "revisit" and got[-1]["refers_to"] == 2 and got[-1]["payload_bytes"] == len(payloads[2])
    assert got[0]["target_uri"] == "http://x/0\r\nEvil: 1"
    assert [gzip.decompress(data[r["offset"] :][: len(data)])[:5] for r in got[-1:]] == [b"WARC/"]


@pytest.mark.parametrize("how", ["cut", "flip", "length", "digest"])
def test_broken_archives(how):
    good = record(1, b"some payload " * 40)
    if how == "cut":
        bad = good[:-9]
    elif how == "flip":
        bad = good[:60] + bytes([good[60] ^ 255]) + good[61:]
    else:
        plain = gzip.decompress(good)
        old, new = (rb"some payload some", b"SOME payload some") if how == "digest" else (rb"Content-Length: \d+", b"Content-Length: 3")
        bad = gzip.compress(re.sub(old, new, plain, count=1))
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(record(0, b"ok") + bad)))


def test_query_cases(spark):
    big = "<p>" + "x" * 200
    rows = [(5, "u", big, 1), (2, "u", big, 1), (2, "u", big, 1), (None, "u", big, 1), (7, None, None, 1), (8, "", "", 1), (1, "a", "small", 1), (3, "b", "small", 1), (9, "ü", "é🙂" * 80000, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(3)
    got = sorted(((r["record_id"], r["payload_bytes"], r["record_type"], r["refers_to"], r["target_uri"]) for r in warc.read_warc(warc.write_warc(df, max_archive_bytes=300)).collect()), key=repr)
    n = len(big)
    want = [(5, n, "revisit", 2, "u"), (2, n, "response", None, "u"), (2, n, "response", None, "u"), (None, n, "revisit", 2, "u"), (7, 0, "response", None, None),
            (8, 0, "response", None, ""), (1, 5, "response", None, "a"), (3, 5, "response", None, "b"), (9, 480000, "response", None, "ü")]
    assert got == sorted(want, key=repr)
    assert warc.read_warc(warc.write_warc(df.limit(0))).count() == 0
