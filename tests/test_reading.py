"""Reading modes, budgets and totals on small rows."""

import hashlib

from pyspark.sql import functions as F

from tallyspark.operators import reading


def test_reading_modes(spark):
    h = lambda x: hashlib.sha256(x).hexdigest()
    rows = [
        (b"a\nb\n", None, None, None, None), (b"a\nb\n", 2, h(b"a\n"), 1, 2), (b"a\nb\n", 2, h(b"a\n"), 2, 2), (b"a\nb\n", 9, "", 1, 2), (b"a\nb\n", 9, "", 1, 1),
        (b"a\n\n", 2, h(b"a\n"), 1, 2), (b"ab\n", 1, h(b"a"), 1, 2), (b"a\nb", 1, h(b"a"), 1, 2), (b"", 0, h(b""), 0, 2), (None, 0, h(b""), 0, 2), ("é\nü".encode(), 3, h("é\n".encode()), 1, 2),
    ]
    f = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, c binary, o int, h string, n int, v int")
    got = f.select("i", reading.reading_mode(*(F.col(x) for x in "cohnv"), 2).alias("x")).orderBy("i").collect()
    want = [("full", None), ("delta", None), ("full", "cursor-mismatch"), ("full", "source-truncated"), ("full", "normalizer-changed"), ("unchanged", None), ("full", "cursor-mismatch"), ("delta", None), ("unchanged", None), ("unchanged", None), ("delta", None)]
    assert [tuple(r["x"]) for r in got] == want


def test_budget_skips_what_does_not_fit(spark):
    rows = [("s", 1, 5), ("s", 2, 11), ("s", 3, 8), ("s", 4, 6), ("s", 5, 5), ("s", 6, 0), (None, 1, 3), (None, 2, None), ("", 1, 9)]
    got = reading.within_budget(spark.createDataFrame(rows, "g string, o int, n int"), "g", "o", "n", 3, 10, 12)
    assert {(r["g"], r["o"]) for r in got.where("taken").collect()} == {("s", 1), ("s", 4), ("s", 6), (None, 1), ("", 1)} and got.count() == 9


def test_totals_of_nothing(spark):
    s, a = spark.createDataFrame([], "status string, superseded long"), spark.createDataFrame([], "result string, bytes long, finding boolean")
    assert set(reading.restore_totals(s, a).first()) == {0}
