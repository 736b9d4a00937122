"""Reading and classifying transcripts on lines written here."""

import json

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import scalars
from tallyspark.operators import records as R
from tallyspark.sources import transcripts as T
from tallyspark.streaming import hooks
from tallyspark.streaming.tables import KeyedTable


def claude(kind, content, **more):
    return json.dumps({"type": kind, "message": {"role": kind, "content": content} | more.pop("message", {}), **more})


LINES = [
    claude("user", "<command-name>/go</command-name> <command-args>now</command-args>", timestamp="2026-01-02T03:04:05.678Z"),
    "",
    claude("assistant", [{"type": "text", "text": " hello "}, {"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "ls -l", "n": 1.0}}], message={"id": "m1", "model": "x", "usage": {"input_tokens": 5, "output_tokens": 7.0}}),
    claude("assistant", [{"type": "thinking"}], message={"id": "m1", "usage": {"input_tokens": 5, "output_tokens": 9}}),
    claude("user", [{"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "a"}, {"type": "image"}, "b"]}]),
    claude("user", [{"type": "tool_result"}]),
    claude("user", [3, {"kind": "untyped"}]),
    json.dumps({"type": "system", "subtype": "compact_boundary", "compactMetadata": {"trigger": "auto", "preTokens": 100}}),
    '{"type": "mode"}',
    '{"type": "brand-new"}',
    '{"no": "type"}',
    "[1]",
    "   ",
    '{"type": "user", "x": NaN}',
    '{"type": "us',
]


@pytest.fixture(scope="module")
def read(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("claude")
    (folder / "s-1.jsonl").write_text("\n".join(LINES))
    return R.classified(T.facts(T.read_lines(spark, str(folder), "claude-code"))).cache()


def test_lines_and_classes(read):
    got = {r["line"]: (r["record"], r["class"], r["ignored_kind"], r["unknown_kind"]) for r in read.collect()}
    assert len(got) == 14 and 2 not in got and got[3][0] == 2
    classes = ["content", "content", "empty", "content", "empty", "ignored", "ignored", "ignored", "unknown", "unknown", "ignored", "error", "error", "error"]
    assert [got[k][1] for k in sorted(got)] == classes
    assert (got[10][3], got[11][3], got[12][2], got[7][2]) == ("brand-new", "<untyped>", "non-object-json", "user")


def test_events(read):
    got = {(r["record"], r["seq"]): r for r in R.events(read).collect()}
    assert got[2, 0]["content"] == "hello" and got[2, 1]["command"] == "ls -l" and got[2, 1]["call_id"] == "t1"
    assert got[2, 1]["content"] == 'event=tool_use input={"command":"ls -l","n":1.0} name=Bash tool_use_id=t1'
    assert got[4, 0]["content"] == "event=tool_result output=a\nb tool_use_id=t1"


def test_folds(read):
    s = R.session_summary(read).first()
    assert (s["session_id"], s["user_requests"], s["assistant_messages"], s["tool_activities"], s["ignored_events"], s["malformed_records"]) == ("s-1", 1, 1, 2, 6, 3)
    usage = R.token_usage(read).first()
    assert (usage["input_tokens"], usage["output_tokens"], usage["thinking_tokens"]) == (5, 9, None)
    assert tuple(R.compactions(read).first())[2:] == (1, 1, 1)
    a = R.parse_accounting(read, ["source"]).first()
    assert a["unknown_kinds"] == {"<untyped>": 1, "brand-new": 1} and a["ignored_kinds"]["system"] == 1 and a["typed_share"] == pytest.approx(9 / 14)
    assert read.where("slash_command is not null").first()["slash_command"].asDict() == {"name": "/go", "args": "now"}


def test_other_harnesses():
    def kinds(source, record):
        f = T.line_facts(source, json.dumps(record))
        return f["shaped"], [dict(e["fields"]) if e["fields"] else (e["kind"], e["text"]) for e in f["events"]]

    call = {"type": "tool.execution_start", "data": {"toolCallId": "c", "toolName": "bash", "arguments": {"command": "ls"}}}
    assert kinds("copilot", call) == (True, [{"event": "tool.execution_start", "tool_call_id": "c", "name": "bash", "arguments": '{"command":"ls"}', "command": "ls"}])
    done = {"type": "tool.execution_complete", "data": {"toolCallId": "c", "success": True, "result": {"contents": [{"type": "shell_exit", "outputPreview": "ok"}]}}}
    assert kinds("copilot", done)[1] == [{"event": "tool.execution_complete", "tool_call_id": "c", "success": "true", "output": "ok"}]
    assert kinds("copilot", {"type": "tool.execution_complete", "data": {"toolCallId": "c", "success": 1}}) == (False, [])
    assert kinds("copilot", {"type": "tool.execution_complete", "data": {"toolCallId": "c", "success": True, "error": {}}}) == (False, [])
    assert kinds("copilot", {"type": "assistant.message", "data": {"content": "x"}}) == (False, [])
    assert kinds("codex", {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "a"}, {"type": "text", "text": "b"}]}}) == (True, [("user", "a\nb")])
    assert kinds("codex", {"type": "response_item", "payload": {"type": "message", "role": "developer", "content": [{"type": "text", "text": "b"}]}}) == (False, [])
    shell = {"type": "response_item", "payload": {"type": "function_call", "call_id": "c", "name": "shell", "arguments": '{"command":["ls","-l"]}'}}
    assert kinds("codex", shell)[1][0]["command"] == '["ls","-l"]'
    out = {"type": "response_item", "payload": {"type": "custom_tool_call_output", "call_id": "c", "output": {"content": [{"text": "a"}, "b"]}}}
    assert kinds("codex", out)[1] == [{"event": "function_call_output", "call_id": "c", "output": "a\nb"}]
    assert T.slash_command("<command-name>/a</command-name><command-name>/b</command-name>") is None and T.slash_command("text <command-name>/a</command-name>") is None


def test_times_and_scalars(spark):
    rows = spark.createDataFrame([("2026-07-11",), ("2026-07-11T01:02:03+02:00",), (None,)], "t string").select(R.utc(F.col("t")).alias("t"))
    assert [str(r[0]) for r in rows.collect()] == ["None", "2026-07-10 23:02:03", "None"]
    one = spark.range(1).select(
        scalars.git_remote(F.lit("git@GitHub.com:a/b.git")).alias("a"), scalars.git_remote(F.lit("https://me@Host.org:443/x/y.git/")).alias("b"),
        scalars.nonempty(F.lit(" 　x\t")).alias("c"), scalars.nonempty(F.lit(" \n")).alias("d"), scalars.size_text(F.lit(1536)).alias("e"), scalars.shortened(F.lit("abcd"), 3).alias("f"),
    ).first()
    assert tuple(one) == ("github.com/a/b", "host.org/x/y", "x", None, "1.5 KB", "abc…")


def test_event_chunks(spark):
    rows = spark.createDataFrame([(1, i, n) for i, n in enumerate([3, 4, 5, 2, 9, 1])], "s long, i long, n long")
    assert [r["chunk"] for r in R.event_chunks(rows, "s", "i", "n", 8).orderBy("i").collect()] == [0, 0, 1, 1, 2, 3]


def test_stream_and_batch_agree(spark, tmp_path):
    events = [("copilot", "a", "agent-stop", 1000, "/p1", None), ("copilot", "a", "agent-stop", 900, "/p0", None), ("copilot", "a", "session-end", 1500, None, "complete"), ("copilot", "a", "session-end", 1500, None, "complete"), ("codex", "b", "agent-stop", 5, "/q", None), ("codex", "c", "session-end", 7, None, "user_exit")]
    names = ("source", "session_id", "kind", "at_ms", "path", "reason")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text("\n".join([*(json.dumps(dict(zip(names, e, strict=True))) for e in events), "not json", "{}", "", '{"session_id": "x", "at_ms": 1, "path": "' + "y" * 70_000 + '"}']))
    table = KeyedTable(spark, str(tmp_path / "table"), ("source", "session_id"), hooks.FOLDED)
    hooks.lifecycle_stream(hooks.read_hooks(spark, str(tmp_path / "in")), table, str(tmp_path / "check")).awaitTermination(120)
    rejected = hooks.rejected_hooks(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("rejected").trigger(availableNow=True).start()
    rejected.awaitTermination(120)
    assert sorted((r["code"], r["length"]) for r in spark.table("rejected").collect()) == [("no-session", 2), ("not-an-object", 8), ("too-large", 70_043)]
    batch = hooks.lifecycle(spark.createDataFrame(events, hooks.SCHEMA))
    assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, batch.collect()))
    a = batch.where("session_id = 'a'").first()
    assert (a["events"], a["transcript_path"], a["lifecycle_state"]) == (3, "/p1", "summary-pending")
    assert [r[0] for r in batch.where("session_id <> 'a'").orderBy("session_id").select("lifecycle_state").collect()] == ["observed", "interrupted"]
