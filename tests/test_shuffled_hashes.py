"""Hashes are shuffled as bytes, and come out as the texts they were."""

import hashlib
import json
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import artifacts, capture

HEX = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(4)]
ODD = [None, "", "sha256:", "x", HEX[1].upper(), HEX[1][:63], HEX[1] + "\n", HEX[1][:63] + "g", HEX[1][:62] + "é", "sha256:sha256:" + HEX[1], "A" * 32, "\0" * 32, "\0" * 33]


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@contextmanager
def shuffled(spark, group):
    """A list that gets, at the end, the bytes and the rows that the jobs within shuffled."""
    sc, found = spark.sparkContext, []
    sc.setJobGroup(group, group)
    yield found
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    ran = [store.lastStageAttempt(s) for s in stages]
    found += [sum(s.shuffleWriteBytes() for s in ran), sum(s.shuffleWriteRecords() for s in ran)]
    sc.setLocalProperty("spark.jobGroup.id", None)


def prefixed(h):
    return h if h is None or h.startswith("sha256:") else "sha256:" + h


def test_packed_hashes_are_unpacked(spark):
    texts = [t for h in HEX + ODD for t in {h, prefixed(h)}]
    packed = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("packed", artifacts.packed_hash(F.col("text")))
    rows = packed.withColumn("again", artifacts.unpacked_hash(F.col("packed"))).collect()
    assert all(r["again"] == r["text"] for r in rows)
    assert {r["text"] for r in rows if r["packed"] is not None and len(r["packed"]) == 32} == {"sha256:" + h for h in HEX}
    assert len({bytes(r["packed"]) for r in rows if r["text"] is not None}) == len({t for t in texts if t is not None})


def test_manifests_keep_odd_hashes(spark):
    pairs = [(a, b) for a in HEX[:2] + ODD for b in HEX[:2] + ODD]
    rows = [(i % 3, i // 3 % 5, "p", "m", i, a, i, b, None) for i, (a, b) in enumerate(pairs)]
    fields = "id long, position int, logical_path string, media_type string, original_size_bytes long, original_sha256 string, stored_size_bytes long, stored_sha256 string, compression string"
    snapshots = spark.createDataFrame([(k, h) for k, h in enumerate((HEX[0], "sha256:" + HEX[0], None, ""))], "id long, source_state_hash string")
    said = [c for c in ("source_agent", "source_session_id", *capture.CAPTURE, "writer_version") if c != "source_state_hash"]
    snapshots = snapshots.select("*", *(F.lit("v").alias(c) for c in said))
    got = {r["id"]: json.loads(r["manifest"]) for r in capture.manifests(snapshots, spark.createDataFrame(rows, fields), "id", "writer").collect()}
    assert [got[k]["capture"]["source_state_hash"] for k in range(4)] == [HEX[0], "sha256:" + HEX[0], None, ""]
    for k in range(4):
        entries = sorted((r[1:] for r in rows if r[0] == k), key=lambda r: (r[0], r[3]))
        want = [dict(zip(capture.ARTIFACT, (p, m, a, prefixed(x), b, prefixed(y), z), strict=True)) for _, p, m, a, x, b, y, z in entries]
        assert got[k]["artifacts"] == want


def test_manifests_shuffle_digests_once_and_as_bytes(spark, no_broadcast):
    n = 20_000
    hashed = F.sha2(F.col("i").cast("string"), 256)
    rows = spark.range(n, numPartitions=4).withColumnRenamed("id", "i").select((F.col("i") * 7919 % n).alias("id"), F.lit(1).alias("position"), F.lit("part/1").alias("logical_path"), F.lit("m").alias("media_type"), F.col("i").alias("original_size_bytes"), hashed.alias("original_sha256"), F.lit(None).cast("long").alias("stored_size_bytes"), F.concat(F.lit("sha256:"), hashed).alias("stored_sha256"), F.lit(None).cast("string").alias("compression"))
    said = [c for c in ("source_agent", "source_session_id", *capture.CAPTURE, "writer_version") if c != "source_state_hash"]
    snapshots = spark.range(n, numPartitions=4).select("id", F.sha2(F.col("id").cast("string"), 256).alias("source_state_hash"), *(F.lit(None).cast("string").alias(c) for c in said))
    with shuffled(spark, "manifests") as found:
        capture.manifests(snapshots, rows, "id", "writer").write.format("noop").mode("overwrite").save()
    assert found[1] == 2 * n and found[0] < 120 * n


def test_known_records_of_odd_hashes(spark, no_broadcast):
    hashes = [t for h in HEX + ODD for t in {h, prefixed(h)}]
    records = [(h, f"r/{i}") for i, h in enumerate(hashes[::2] + hashes[::3])]
    found = artifacts.known_records(spark.createDataFrame([(i, h) for i, h in enumerate(hashes)], "id int, original_sha256 string"), spark.createDataFrame(records, "markdown_hash string, relative_path string")).collect()
    known = {}
    for h, path in records:
        known[prefixed(h)] = max(known.get(prefixed(h), ""), path)
    known.pop(None)
    assert {r["id"]: r["local_path"] for r in found} == {i: known.get(prefixed(h)) for i, h in enumerate(hashes)} and len(found) == len(hashes)
    assert all(r["original_sha256"] == hashes[r["id"]] for r in found) and any(r["local_path"] for r in found) and not all(r["local_path"] for r in found)


def test_known_records_shuffle_digests_as_bytes(spark, no_broadcast):
    n = 20_000
    rows = spark.range(n, numPartitions=4).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h"))
    with shuffled(spark, "known") as found:
        artifacts.known_records(rows.withColumnRenamed("h", "original_sha256"), rows.select(F.concat(F.lit("sha256:"), "h").alias("markdown_hash"), F.lit("r").alias("relative_path"))).select("id", "local_path").write.format("noop").mode("overwrite").save()
    assert found[1] == 2 * n and found[0] < 100 * n
