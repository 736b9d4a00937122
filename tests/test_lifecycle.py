"""Each transition of a session's state; the stream gives what the batch fold gives, in whatever order events come."""

import json
import random
import time
from types import SimpleNamespace

import pytest

from tallyspark.streaming import lifecycle
from tallyspark.streaming.lifecycle import Session
from tallyspark.streaming.tables import KeyedTable

MINUTE = 60_000
_NAMES = [x.split(" ")[0] for x in lifecycle.EVENTS.split(", ")]


def event(kind, at_ms=1000, **more):
    return SimpleNamespace(**(dict.fromkeys(_NAMES) | {"kind": kind, "at_ms": at_ms} | more))


def after(*events, start=None):
    s = start or Session()
    for e in events:
        s.take(e)
    return s


STOP, END, CLAIM = event("agent-stop", 1, path="p"), event("session-end", 2, reason="complete"), event("claim", 3, attempt="a", lease_ms=10)
PENDING = (STOP, END)
HELD = (*PENDING, CLAIM)
DONE = (*HELD, event("success", 4, attempt="a"))


@pytest.mark.parametrize(
    "events,want",
    [
        ([STOP], ("observed", 1, True)),
        ([*PENDING], ("summary-pending", 2, False)),
        ([STOP, event("session-end", 2, reason="user_exit")], ("interrupted", 2, False)),
        ([STOP, event("session-end", 2)], ("interrupted", 2, False)),
        ([*HELD], ("processing", 2, False)),
        ([*HELD, STOP], ("processing", 3, True)),
        ([*HELD, END], ("processing", 3, False)),
        ([*DONE], ("archived", 2, False)),
        ([*HELD, STOP, event("success", 4)], ("revision-pending", 3, True)),
        ([*DONE, STOP], ("revision-pending", 3, True)),
        ([*DONE, event("session-end", 9, reason="user_exit")], ("revision-pending", 3, False)),
        ([*HELD, event("placeholder", 4, category="c")], ("failed", 2, False)),
        ([*HELD, event("failure", 4, category="c", retryable=True)], ("failed", 2, False)),
        ([*HELD, event("failure", 4, category="source-missing")], ("observed", 2, False)),
        ([*HELD, event("deferral", 4, category="budget")], ("summary-pending", 2, False)),
        ([*DONE, END, CLAIM, event("failure", 5, category="source-failed"), event("accepted-loss", 6)], ("observed", 3, False)),
        ([*PENDING, event("nonsense")], ("summary-pending", 2, False)),
    ],
)
def test_transitions(events, want):
    s = after(*events)
    assert (s.lifecycle_state, s.generation, s.active) == want
    assert s.events == len(events)


def test_reports_that_do_not_fit_change_nothing():
    for events, kind in [(PENDING, "success"), ((STOP,), "claim"), (HELD, "claim"), (PENDING, "accepted-loss"), (DONE, "retry"), (DONE, "claim"), (HELD, "accepted-loss")]:
        was, s = after(*events), after(*events, event(kind, 5, attempt="b", lease_ms=1))
        assert s.ignored == was.ignored + 1
        was.events, was.ignored = s.events, s.ignored
        assert s == was
    assert after(*HELD, event("success", 4, attempt="other")).lifecycle_state == "processing"


def test_times_and_path_of_the_newest_stop():
    s = after(event("agent-stop", 5, path="new"), event("agent-stop", 3, path="old"), event("agent-stop", 5, path="same time"))
    assert (s.last_agent_stop_ms, s.transcript_path) == (5, "same time")
    assert after(END).last_error_category == "transcript-unresolved" and after(*PENDING).last_error_category is None


def test_failures_follow_the_schedule_and_park_at_the_fifth():
    s, now, waits = after(*PENDING), 1000, []
    for i in range(5):
        s = after(event("claim", now, attempt=str(i), lease_ms=1), event("failure", now, category="c", retryable=True), start=s)
        waits.append((s.next_retry_at_ms - now) // MINUTE if s.next_retry_at_ms > 0 else -1)
        now = max(s.next_retry_at_ms, now)
    assert waits == [10, 30, 90, 240, -1] and s.parked and s.streak == 5 and s.due_at() is None
    assert after(event("claim", now), start=s).lifecycle_state == "failed"
    lifted = after(event("retry", now), start=s)
    assert lifted.streak == 0 and lifted.due_at() == 0
    assert after(event("claim", now, attempt="z"), start=lifted).lifecycle_state == "processing"


def test_streaks_begin_anew():
    fail = lambda at, c: (event("claim", at, attempt="a", lease_ms=1), event("failure", at, category=c, retryable=True))
    assert after(*PENDING, *fail(10**9, "c"), *fail(2 * 10**9, "d")).streak == 1
    assert after(*PENDING, *fail(10**9, "c"), *fail(2 * 10**9, "c")).streak == 2
    assert after(*PENDING, *fail(10**9, "c"), END, *fail(2 * 10**9, "c")).streak == 1
    assert after(*PENDING, CLAIM, event("failure", 9, category="c")).parked, "what can't be retried parks at once"
    assert after(*HELD, event("placeholder", 4, category="c")).streak == 5
    early = after(*PENDING, *fail(10**9, "c"), event("claim", 10**9 + 1))
    assert early.lifecycle_state == "failed" and after(event("claim", 10**9 + 1, forced=True), start=early).lifecycle_state == "processing"


def test_a_lease_that_ran_out_makes_the_session_due():
    s = after(*HELD)
    assert s.due_at() == 13
    assert after(event("claim", 12, attempt="b", lease_ms=5), start=after(*HELD)).attempt == "a"
    again = after(event("claim", 13, attempt="b", lease_ms=5), start=s)
    assert (again.attempt, again.retry_state, again.lease_expires_at_ms) == ("b", "summary-pending", 18)
    assert after(event("success", 14, attempt="a"), start=again).lifecycle_state == "processing", "who lost the lease can't commit"


def made(rng, n, sessions):
    rows = []
    for i in range(n):
        kind = rng.choice(["agent-stop", "session-end", "session-end", "claim", "claim", "claim", "failure", "failure", "success", "placeholder", "deferral", "retry", "accepted-loss", "odd"])
        rows.append({"source": "x", "session_id": f"s{rng.randrange(sessions)}", "kind": kind, "at_ms": 1_700_000_000_000 + rng.randrange(400) * 10 * MINUTE, "key": f"k{i:05d}", "path": rng.choice(["p", "q"]), "reason": rng.choice(["complete", "user_exit"]), "lease_ms": MINUTE, "category": rng.choice(["c", "c", "source-failed", "source-missing"]), "retryable": rng.random() < 0.9, "forced": rng.random() < 0.2})
    return rows


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def plain(rows):
    """Sessions' states by a plain fold."""
    found = {}
    for e in sorted({r["key"]: r for r in rows}.values(), key=lambda r: (r["at_ms"], r["key"])):
        found.setdefault(e["session_id"], Session()).take(SimpleNamespace(**(dict.fromkeys(_NAMES) | e)))
    return {k: {**vars(s), "due_at_ms": s.due_at()} for k, s in found.items()}


def as_read(frame):
    return {r["session_id"]: {k: v for k, v in r.asDict().items() if k not in ("source", "session_id")} for r in frame.collect()}


@pytest.mark.parametrize("keep_ms", [None, 10**13])
def test_stream_equals_batch(rocks, tmp_path, keep_ms):
    rng = random.Random(8)
    rows = made(rng, 400, 9)
    batch = lifecycle.lifecycle(rocks.createDataFrame([tuple(r.get(n) for n in _NAMES) for r in rows + rows[:50]], lifecycle.EVENTS))
    want = plain(rows)
    assert as_read(batch) == want
    table = KeyedTable(rocks, str(tmp_path / "table"), ("source", "session_id"), lifecycle.ROWS)
    assert table.read().count() == 0
    rng.shuffle(rows)
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        part = rows[i * 150 : (i + 1) * 150] + rng.sample(rows[: (i + 1) * 150], 20)
        (folder / f"{i}.json").write_text("".join(json.dumps(r) + "\n" for r in part) + '{"kind": "claim"}\n')
        lifecycle.keep_states(lifecycle.read_events(rocks, str(folder)), table, str(tmp_path / "checkpoint"), keep_ms).awaitTermination()
    assert as_read(table.read()) == want
    assert as_read(table.compact(1, str(tmp_path / "compact")).read()) == want
    assert {r["session_id"] for r in lifecycle.eligible(table.read(), 2 * 10**12).collect()} == {k for k, s in want.items() if s["due_at_ms"] is not None}


def test_old_events_go_to_the_base(rocks, tmp_path):
    """With a horizon, what is in order gives the same state; the events kept are few."""
    rng = random.Random(5)
    rows = sorted(made(rng, 200, 3), key=lambda r: (r["at_ms"], r["key"]))
    table = KeyedTable(rocks, str(tmp_path / "table"), ("source", "session_id"), lifecycle.ROWS)
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(2):
        (folder / f"{i}.json").write_text("".join(json.dumps(r) + "\n" for r in rows[i * 100 : (i + 1) * 100]))
        lifecycle.keep_states(lifecycle.read_events(rocks, str(folder)), table, str(tmp_path / "checkpoint"), 60 * MINUTE).awaitTermination()
    assert as_read(table.read()) == plain(rows)
    kept = rocks.read.format("statestore").option("stateVarName", "events").load(str(tmp_path / "checkpoint")).count()
    assert 0 < kept < 40


def test_timer_gives_the_row_when_a_lease_runs_out(rocks, tmp_path):
    folder, now = tmp_path / "in", int(time.time() * 1000)
    folder.mkdir()
    rows = [{"source": "x", "session_id": "s", "kind": k, "at_ms": now + i, "key": str(i), "path": "p", "reason": "complete", "lease_ms": 3000} for i, k in enumerate(["agent-stop", "session-end", "claim"])]
    (folder / "0.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    table = KeyedTable(rocks, str(tmp_path / "table"), ("source", "session_id"), lifecycle.ROWS)
    running = lifecycle.keep_states(lifecycle.read_events(rocks, str(folder)), table, str(tmp_path / "checkpoint"), trigger={"processingTime": "1 second"})
    try:
        until = time.time() + 90
        while time.time() < until and table.batches().count() < 2:
            time.sleep(1)
    finally:
        running.stop()
    batches = table.batches().orderBy("batch").collect()
    assert [r["lifecycle_state"] for r in batches] == ["processing"] * 2
    assert batches[0]["due_at_ms"] == now + 2 + 3000 == batches[1]["due_at_ms"]
