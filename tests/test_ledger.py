"""The sink ledger's transitions, and commits in two phases that run again."""

from types import SimpleNamespace

from tallyspark.streaming import ledger
from tallyspark.streaming.ledger import Commits, Delivery
from tallyspark.streaming.tables import KeyedTable

MINUTE = 60_000


def after(*kinds, start=None, at=0, **more):
    d = start or Delivery()
    for kind in kinds:
        d.take(SimpleNamespace(**{"kind": kind, "at_ms": at, "revision": 3, "hash": "h", "category": "c", "forced": False} | more))
    return d


def test_failures_wait_longer_and_end_as_dead_letter():
    waits = [after(*["failure"] * n).next_attempt_at_ms for n in range(1, 6)]
    assert waits == [MINUTE, 2 * MINUTE, 4 * MINUTE, 8 * MINUTE, None]
    assert [ledger.wait_ms(n) for n in (0, 1, 7, 99)] == [MINUTE, MINUTE, 60 * MINUTE, 60 * MINUTE]
    dead = after(*["failure"] * 5)
    assert (dead.delivery_state, dead.attempts) == ("dead-letter", 5)
    assert after("retry", start=after(*["failure"] * 5)).delivery_state == "dead-letter"
    lifted = after("retry", start=after(*["failure"] * 5), forced=True)
    assert (lifted.delivery_state, lifted.attempts) == ("pending", 0)


def test_success_resets_and_blocks_do_not_count():
    d = after("failure", "failure", "success")
    assert (d.delivery_state, d.attempts, d.delivered_revision, d.last_error_category) == ("delivered", 0, 3, None)
    assert after("failure", "blocked", "blocked").attempts == 1
    assert (after("failure", "retry").attempts, after("failure", "retry").delivery_state) == (1, "pending")
    assert after("nonsense") == Delivery()


def plan(session, revision, attempt="a", **more):
    names = [x.split(" ")[0] for x in ledger.PLANNED]
    values = {"record_count": 1, "byte_offset": 2, "prefix_hash": "p", "history": True} | more
    return (session, revision, attempt, *(values.get(n) for n in names))


def test_commits_take_effect_once(spark, tmp_path):
    table = lambda name, schema: KeyedTable(spark, str(tmp_path / name), ledger.COMMIT_KEYS, schema)
    two = Commits(table("plans", ledger.PLAN), table("commits", ledger.PLAN), table("rejected", ledger.PLAN + ", verdict string"))
    rows = lambda *x: spark.createDataFrame(list(x), ledger.PLAN)
    two.plan(rows(plan("s", 1), plan("t", 1), plan("u", 1, fallback_reason="x")), 0)
    first = rows(plan("s", 1), plan("t", 1, byte_offset=9), plan("u", 1), plan("v", 1))

    def state():
        return sorted((r["session_id"], r["revision"], r["attempt"]) for r in two.commits.read().collect()), sorted((r["session_id"], r["verdict"]) for r in two.rejected.read().collect())

    two.commit(first, 1)
    want = [("s", 1, "a")], [("t", "invalid"), ("u", "invalid"), ("v", "no-plan")]
    assert state() == want
    two.commit(first, 1)
    assert state() == want, "the same batch again changes nothing"
    two.plan(rows(plan("s", 1, "b", source_bytes=5), plan("s", 2)), 2)
    two.commit(rows(plan("s", 1, "b", source_bytes=5), plan("s", 2)), 3)
    assert state() == ([("s", 1, "a"), ("s", 2, "a")], [("s", "repeated"), *want[1]])
