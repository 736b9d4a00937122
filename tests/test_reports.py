"""Reports and corrected operators on small rows with the cases the test tables lack."""

from pyspark.sql import functions as F

from tallyspark.functions import scalars
from tallyspark.operators import artifacts, records, reports, sessions


def test_line_search_counts_trailing_blank_lines(spark):
    rows = [(1, "hit\n\n\n"), (2, "hit"), (3, "hit\r\n"), (4, "a\nb\nhit\nc\nd\ne\nf\ng\nHIT"), (5, ""), (6, None)]
    got = {tuple(r) for r in artifacts.line_search(spark.createDataFrame(rows, "seq long, content string"), "Hit").collect()}
    assert got == {(1, 0, 2, 1), (2, 0, 0, 1), (3, 0, 0, 1), (4, 0, 4, 1), (4, 6, 8, 1)}


def test_slug_keeps_single_dashes(spark):
    texts = ["My  App", "--a--b--", "###", "", "x" * 47 + "-yz", "Ünder"]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").orderBy("i").select(scalars.slug(F.col("t"))).collect()]
    assert got == ["my--app", "a--b", "project", "project", "x" * 47 + "-", "nder"]


def test_reconcile_by_endpoint(spark):
    local = spark.createDataFrame([("e", None, None), ("e", 1, "s"), ("e", 2, None), ("e", 3, None), ("e", 3, "s"), ("f", 2, None)], "endpoint string, snapshot_id long, remote_session_id string")
    remote = spark.createDataFrame([(1, "s1"), (2, "s2")], "snapshot_id long, session_id string")
    assert {tuple(r) for r in sessions.reconcile(local, remote, "e").collect()} == {("no-snapshot", 1), ("already", 2), ("reconciled", 1), ("unmatched", 1)}
    assert {tuple(r) for r in sessions.reconcile(local, remote, "e", True).collect()} == {("no-snapshot", 1), ("already", 1), ("reconciled", 1), ("repaired", 2)}


def test_event_chunks_of_a_long_session(spark):
    rows = spark.range(20_000).select(F.lit(1).alias("s"), F.col("id").alias("at"), F.lit(10).alias("size")).unionByName(spark.createDataFrame([(None, 0, 5), (None, 1, 200), (None, 2, None)], "s int, at long, size int"))
    got = records.event_chunks(rows, "s", "at", "size", 100)
    assert got.where("s = 1 and chunk <> at div 10").count() == 0 and got.count() == 20_003
    assert [r["chunk"] for r in got.where("s is null").orderBy("at").collect()] == [0, 1, 2]


def test_event_chunks_of_null_and_empty_sessions(spark):
    rows = spark.createDataFrame([(None, 0, 5), ("", 0, 5), (None, 1, 4)], "s string, at long, size int")
    assert {tuple(r) for r in records.event_chunks(rows, "s", "at", "size", 8).collect()} == {(None, 0, 0), ("", 0, 0), (None, 1, 1)}


def test_summary_violations(spark):
    good = ("t", "g\nh", ["x"], ["a"])
    rows = [(0, *good), (1, " ", *good[1:]), (2, "a\nb", "x\n## y", [], ["z" * 101]), (3, "t\x07", None, ["a\nb"], ["x"] * 201)]
    frame = spark.createDataFrame(rows, "id int, title string, goal string, work_completed array<string>, tags array<string>")
    got = {tuple(r) for r in reports.summary_violations(frame, "id", ("work_completed", "tags")).collect()}
    text = "invalid-text"
    assert got == {(1, "title", text), (2, "title", text), (2, "goal", text), (2, "work_completed", "missing-items"), (2, "tags", text), (3, "title", text), (3, "goal", text), (3, "work_completed", text), (3, "tags", "too-many-items")}


def test_placeholder_and_eligibility(spark):
    tags = spark.createDataFrame([(["a", "stand-in"],), (["a"],), (None,)], "tags array<string>")
    assert [r[0] for r in tags.select(reports.is_placeholder(F.col("tags"), "stand-in")).collect()] == [True, False, False]
    rows = [(None, None, None), ("synced", "h", None), ("synced", "x", None), ("failed", "h", 5), ("failed", "h", 50), ("dead-letter", "h", None), ("blocked", "h", None)]
    frame = spark.createDataFrame(rows, "state string, hash string, at long")
    of = lambda force: [r[0] for r in frame.select(reports.sync_eligibility(F.col("state"), F.col("hash"), F.col("at"), F.lit("h"), 10, force)).collect()]
    assert of(False) == ["sync", "unchanged", "sync", "sync", "deferred", "unchanged", "sync"]
    assert of(True) == ["sync", "unchanged", "sync", "sync", "sync", "sync", "sync"]


def test_saturating_sums(spark):
    most = (1 << 63) - 1
    frame = spark.createDataFrame([("a", most, 1), ("a", 5, 2), ("b", -most, 1), ("b", -most, 1), ("c", None, 1), ("d", 3, 1)], "state string, bytes long, attempts long")
    assert {(r["state"], r["bytes"]) for r in sessions.ledger_status(frame).collect()} == {("a", most), ("b", -most - 1), ("c", None), ("d", 3)}


def test_inserted_keeps_what_is_there(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v long")
    got = sessions.inserted(rows(("a", 1), (None, 2)), rows(("a", 9), ("b", 5), ("b", 4), (None, 7)), ["k"], "v")
    assert {tuple(r) for r in got.collect()} == {("a", 1), (None, 2), ("b", 4)}
