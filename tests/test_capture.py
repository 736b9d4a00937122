"""Sanitised lines at any depth, profiles and exhaust on small rows."""

import json
import random

from pyspark.sql import functions as F

from tallyspark.operators import capture


def made(rng, depth=0):
    kind = rng.randrange(8 if depth < 4 else 5)
    if kind < 2:
        return rng.choice(["secret", "kept", "", "é\n\"", "en"])
    if kind == 2:
        return rng.choice([0, -1, 2**70, 1.5, 1e300])
    if kind < 5:
        return rng.choice([None, True, False])
    if kind < 6:
        return [made(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "b", "secret", "kept"]): made(rng, depth + 1) for _ in range(rng.randrange(4))}


def strings(x):
    if isinstance(x, dict):
        return [s for v in x.values() for s in strings(v)]
    return [s for v in x for s in strings(v)] if isinstance(x, list) else [x] if isinstance(x, str) else []


def shape(x):
    if isinstance(x, dict):
        return {k: shape(v) for k, v in x.items()}
    return [shape(v) for v in x] if isinstance(x, list) else "s" if isinstance(x, str) else x


def test_only_kept_strings_stay(spark):
    rng = random.Random(2)
    values = [made(rng) for _ in range(300)]
    texts = [json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2])) for v in values] + ['{"a":1,"a":"x"}', "{", "", None, "NaN", '{"a":1} x']
    rows = capture.sanitized(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw string"), keep=("kept", "en")).orderBy("i").collect()
    assert [r["valid"] for r in rows] == [True] * 301 + [False] * 5 and all(r["raw"] is None for r in rows[301:])
    assert rows[300]["raw"] == '{"a":"redacted"}'
    for value, r in zip(values, rows, strict=False):
        got = json.loads(r["raw"])
        assert shape(got) == shape(value) and set(strings(got)) <= {"kept", "en", "redacted"}
        assert [s for s in strings(got) if s != "redacted"] == [s for s in strings(value) if s in ("kept", "en")]
        assert r["raw"] == json.dumps(got, separators=(",", ":"), ensure_ascii=False)


def test_profile_and_discriminators(spark):
    texts = ['{"t": "a"}\n\n[1]\n{"t": 1, "u": [1]}\nbad', '{"t": "a", "u": null}\n', "", None, "\n"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    assert tuple(capture.profile(frame).first()) == (sum(len(t) for t in texts if t), 7, 4, 3)
    lines = frame.where("text is not null").select(F.explode(F.split("text", "\n")).alias("raw"))
    assert {tuple(r) for r in capture.discriminators(lines, ("t", "u", "v")).collect()} == {("t", '"a"', 2), ("t", "1", 1), ("u", "null", 1)}


def test_exhaust_is_told_by_the_first_event_of_the_user(spark):
    known = ("Sum up", "Reduce")
    rows = [("a", 1, "tool", "x"), ("a", 2, "user", '{"v":2,"instruction":"Sum up this"}'), ("b", 1, "user", "hello"), ("b", 2, "user", '"instruction":"Sum up'), ("c", 1, "user", '"instruction":"other" "instruction":"Reduce'), ("d", 1, "user", 'pre {"instruction":"Reduce'), ("e", 1, "user", None), ("f", 1, "user", '"instruction": "Sum up')]
    frame = spark.createDataFrame(rows, "session_id string, seq int, kind string, content string")
    assert {r[0] for r in capture.exhaust_sessions(frame, known).collect()} == {"a", "d"}
