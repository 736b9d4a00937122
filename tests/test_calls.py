"""Tool calls and results: pairs in order against a plain queue, and as a stream."""

import json
import random
from collections import Counter, deque

from pyspark.sql import functions as F

from tallyspark.operators import calls


def plain(rows):
    waiting, seen, out = {}, {}, []
    for session, seq, call, phase in sorted(rows, key=lambda r: (r[1], r[3] == "result")):
        if phase not in ("call", "result"):
            continue
        if call is None:
            out.append((session, None, seq if phase == "call" else None, seq if phase == "result" else None, "unanswered" if phase == "call" else "no-call"))
            continue
        seen.setdefault((session, call), Counter())[phase] += 1
        queue = waiting.setdefault((session, call), deque())
        if phase == "call":
            queue.append(seq)
        elif queue:
            out.append((session, call, queue.popleft(), seq, "answered"))
        else:
            out.append((session, call, None, seq, "no-call"))
    out += [(*k, seq, None, "unanswered") for k, queue in waiting.items() for seq in queue]
    return Counter((*r, r[1] is not None and max(seen[r[:2]].values()) > 1) for r in out)


def test_pairs(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["s", "t", None]), rng.randrange(150), rng.choice(["a", "b", "", None]), rng.choice(["call", "result", "result", "other"])) for _ in range(400)]
    rows = [(s or "u", seq * 1000 + i, c, p) for i, (s, seq, c, p) in enumerate(rows)] + [("v", 5, "x", "result"), ("v", 5, "x", "call"), ("w", 1, "once", "call"), ("w", 2, "once", "result")]
    frame = spark.createDataFrame(rows, "session_id string, seq long, call_id string, phase string")
    assert Counter(map(tuple, calls.paired(frame).collect())) == plain(rows)
    assert calls.paired(frame.where("false")).count() == 0


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    stamp = lambda m: f"2024-01-01T{m // 60:02d}:{m % 60:02d}:00Z"
    first = [("s", "answered", "call", 0), ("s", "late", "call", 1), ("s", "alone", "call", 2), ("s", "odd", "result", 3), ("t", "answered", "result", 4), ("s", None, "call", 4)]
    second = [("s", "answered", "result", 5), ("s", "late", "result", 90), ("z", "end", "call", 600)]
    third = [("z", "end", "result", 601)]
    schema = "session_id string, call_id string, phase string, at timestamp"
    for i, rows in enumerate([first, second, third]):
        (folder / f"{i}.json").write_text("".join(json.dumps(dict(zip(("session_id", "call_id", "phase", "at"), (*r[:3], stamp(r[3])), strict=True))) + "\n" for r in rows))
        stream = calls.paired_stream(spark.readStream.schema(schema).json(str(folder)), "1 hour", "10 minutes")
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
    got = Counter((r["session_id"], r["call_id"], r["status"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == Counter([("s", "answered", "answered"), ("s", "late", "unanswered"), ("s", "late", "no-call"), ("s", "alone", "unanswered"), ("s", "odd", "no-call"), ("t", "answered", "no-call"), ("z", "end", "answered")])
    assert spark.read.parquet(str(tmp_path / "out")).where(F.col("result_at") < F.col("call_at")).count() == 0
