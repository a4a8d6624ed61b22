import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.functions import payload
from cairn.sources import codec
from cairn.sources.store import SCHEMAS


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300))
def test_payload(data):
    assert payload.unpack(payload.pack(data)) == data and len(payload.pack(data)) <= len(data) + 1


def test_payload_limits(spark):
    big = payload.pack(bytes(1000))
    assert big[:1] == payload.ZSTD and payload.pack(b"ab")[:1] == payload.PLAIN
    for bad in (lambda: payload.unpack(big, most=999), lambda: payload.unpack(b"\x07x"), lambda: payload.unpack(b""), lambda: payload.unpack(b"\x01junk")):
        with pytest.raises(ValueError):
            bad()
    df = spark.createDataFrame([(1, b"x" * 500), (2, b""), (3, None)], "i int, data binary")
    back = df.withColumn("e", payload.encode_payload("data")).withColumn("d", payload.decode_payload("e"))
    assert back.where(~F.col("d").eqNullSafe(F.col("data"))).count() == 0
    assert spark.createDataFrame([(b"\x07",)], "e binary").select(payload.decode_payload("e")).first()[0] is None


def test_snapshots(spark):
    s = spark.createDataFrame([("s1", None, 'm "é"', "a", 1, ["t"], 3, 2), ("s2", "s1", None, None, None, None, None, None)], SCHEMAS["snapshots"])
    e = spark.createDataFrame([("s1", "b", 420, 1, None, "h", ["c", None], None, {"z": "1", "a": None}), ("s1", "a", None, None, 5, None, None, "m", None)], SCHEMAS["file_entries"])
    blobs = codec.encode(s, e)
    snaps, files = codec.decode(blobs)
    assert sorted(map(str, snaps.collect())) == sorted(map(str, s.collect()))
    assert {r.path: r.asDict() for r in files.collect()} == {r.path: r.asDict() for r in e.collect()}
    again = {r.snapshot_id: r.blob_digest for r in codec.encode(s, e.orderBy("path")).collect()}
    assert again == {r.snapshot_id: r.blob_digest for r in blobs.collect()}
    assert codec.decode(blobs.withColumn("blob", F.concat("blob", F.lit(" "))))[0].count() == 0
    assert codec.encode(s.limit(0), e.limit(0)).count() == 0
