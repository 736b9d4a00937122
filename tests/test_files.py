"""Stable reading with rejected rows, leading records, and files that grow as a stream."""

import json
import os
import random
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from tallyspark.operators.reading import reading_mode
from tallyspark.sources import files
from tallyspark.streaming import growing


def test_read_stable(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    folder.mkdir()
    good = '{"a": 1}\n\n[2]\n"tail"'
    for name, text in {"good": good, "empty": "", "blank": "\n\n", "cut": '{"a": 1}\n{"b": ', "odd": 'not json\n{"c": 3}\n', "large": "x" * 5000, "moved": '{"d": 4}\n'}.items():
        (folder / f"{name}.jsonl").write_text(text)
    listed = files.listed

    def after(spark, path):
        # a file grows between what is read and what is listed then
        if (tmp_path / "out/read/_SUCCESS").exists():
            with (folder / "moved.jsonl").open("a") as f:
                f.write('{"e": 5}\n')
        return listed(spark, path)

    monkeypatch.setattr(files, "listed", after)
    accepted, rejected = files.read_stable(spark, str(folder), "codex", str(tmp_path / "out"), max_bytes=4000)
    assert {(r["session_id"], r["code"]) for r in rejected.collect()} == {("large", "source-limit"), ("cut", "incomplete-trailing-record"), ("moved", "changed-during-read")}
    assert {tuple(r) for r in accepted.select("session_id", "line", "record", "raw").collect()} == {("good", 1, 1, '{"a": 1}'), ("good", 3, 2, "[2]"), ("good", 4, 3, '"tail"'), ("odd", 1, 1, "not json"), ("odd", 2, 2, '{"c": 3}')}


def plain_facts(path):
    """Facts of the first records of a whole file."""
    facts = {"cwd": None, "git_branch": None, "agent_version": None}
    for line in path.read_bytes().split(b"\n")[: files.LEADING_RECORDS]:
        if len(line) >= files.LEADING_BYTES:
            break
        if line.strip(b"\r"):
            try:
                record = json.loads(line)
            except ValueError:
                break
            if not isinstance(record, dict):
                break
            for name, key in (("cwd", "cwd"), ("git_branch", "gitBranch"), ("agent_version", "version")):
                value = record.get(key)
                if facts[name] is None and isinstance(value, str) and value and (name != "cwd" or value.startswith("/")):
                    facts[name] = value
    return facts


def test_leading_facts(spark, tmp_path):
    rng, names = random.Random(2), []
    for i in range(40):
        lines = []
        for j in range(rng.randint(0, 60)):
            record = {"type": "user", "sessionId": "s", "n": j, "text": "x" * rng.randint(0, 2000)}
            if rng.random() < 0.06:
                record["cwd"] = rng.choice(["/a/b", "relative", "", 5])
            if rng.random() < 0.06:
                record["gitBranch"] = rng.choice(["main", ""])
            if rng.random() < 0.06:
                record["version"] = "2.1"
            lines.append("" if rng.random() < 0.1 else "{broken" if rng.random() < 0.01 else "[1]" if rng.random() < 0.01 else json.dumps(record))
        (tmp_path / f"{i}.jsonl").write_text("\n".join(lines))
        names.append(tmp_path / f"{i}.jsonl")
    (tmp_path / "long.jsonl").write_text(json.dumps({"type": "user", "uuid": "u"}) + "\n" + json.dumps({"cwd": "/x", "t": "y" * 300_000}) + "\n" + "z" * 5_000_000)
    names.append(tmp_path / "long.jsonl")
    got = {r["path"].rsplit("/", 1)[-1]: r for r in files.read_leading(spark, str(tmp_path), "claude-code").collect()}
    for name in names:
        want = plain_facts(name)
        r = got[name.name]
        assert {k: r[k] for k in want} == want, name
        assert r["bytes_read"] <= os.path.getsize(name)
    assert got["long.jsonl"]["supported"] and got["long.jsonl"]["bytes_read"] < 600_000
    stale = files.stale_and_supported(files.read_leading(spark, str(tmp_path), "claude-code"), F.lit("2999-01-01").cast("timestamp"))
    assert stale.count() == sum(r["supported"] for r in got.values())


@pytest.mark.parametrize(
    "source,record,want",
    [
        ("copilot", {"id": "i", "timestamp": 1, "parentId": None, "type": "t", "data": {}}, True),
        ("copilot", {"id": "i", "timestamp": 1, "type": "t", "data": {}}, False),
        ("claude-code", {"type": "t", "message": {}}, True),
        ("claude-code", {"type": "t", "uuid": 1, "payload": 1}, False),
        ("claude-code", {"type": "t", "message": "no"}, False),
        ("codex", {"type": "t", "timestamp": 1, "payload": None}, True),
        ("codex", {"type": 1, "timestamp": 1, "payload": {}}, False),
        ("other", {"type": "t", "timestamp": 1, "payload": {}}, False),
    ],
)
def test_envelope(source, record, want):
    assert files.fits(source, record) is want


def test_workspace():
    assert files.workspace_cwd('a: 1\ncwd: "/x y"\ncwd: /z') == "/x y"
    assert files.workspace_cwd(" cwd: /x") is None and files.workspace_cwd("cwd: rel") is None
    assert files.workspace_cwd("\n" * 64 + "cwd: /x") is None


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def line(i):
    return json.dumps({"i": i}) + "\n"


def test_growing_files_are_read_on(rocks, tmp_path):
    folder, out = tmp_path / "in/deep", tmp_path / "out"
    folder.mkdir(parents=True)

    def run(version=1):
        lines = growing.appended(growing.read_growing(rocks, str(tmp_path / "in")), version, max_bytes=10_000)
        seen = rocks.read.schema(growing.LINES).parquet(str(out)).count() if out.exists() else 0
        writer = lines.writeStream.outputMode("append").format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / f"checkpoint{version}"))
        writer.trigger(availableNow=True).start().awaitTermination()
        return seen

    before: set = set()

    def step(**texts):
        """What is new after the files are as given: ({(file, mode, reason, code)}, {file: records})."""
        nonlocal before
        time.sleep(0.05)
        for name, text in texts.items():
            (folder / f"{name}.jsonl").write_text(text)
        run()
        rows = [(r["path"].rsplit("/", 1)[-1][:-6], *tuple(r)[1:]) for r in rocks.read.schema(growing.LINES).parquet(str(out)).collect()]
        left = list(rows)
        for r in before:
            left.remove(r)
        before = rows
        return {r[:4] for r in left if r[4] is None and r[0] in texts}, {(r[0], r[4], json.loads(r[5])["i"]) for r in left if r[4] is not None}

    a, b = line(1) + line(2), line(10)
    assert step(a=a, b=b) == ({("a", "full", None, None), ("b", "full", None, None)}, {("a", 1, 1), ("a", 2, 2), ("b", 1, 10)})
    a += "\n" + line(3) + '{"i": 4'
    assert step(a=a) == ({("a", "delta", None, "incomplete-trailing-record")}, {("a", 3, 3)})
    a += "4}"
    assert step(a=a) == ({("a", "delta", None, None)}, {("a", 4, 44)})
    assert step(a=line(7), b=line(11) + line(12)) == ({("a", "full", "source-truncated", None), ("b", "full", "cursor-mismatch", None)}, {("a", 1, 7), ("b", 1, 11), ("b", 2, 12)})
    assert step(b=line(11) + line(12) + "\n") == ({("b", "unchanged", None, None)}, set())
    assert step(b="x" * 10_001) == ({("b", "rejected", None, "source-limit")}, set())


def test_modes_are_those_of_the_batch_form(spark):
    rng, rows = random.Random(6), []
    for _ in range(300):
        data = "".join(rng.choice([line(rng.randrange(5)), "\n", '"x"\n']) for _ in range(rng.randrange(6))) + rng.choice(["", "", '"tail"'])
        old = data[: rng.randint(0, len(data))] if rng.random() < 0.8 else line(rng.randrange(5)) * rng.randint(0, 5)
        at = (len(old), growing.count(old.encode()), growing.hashlib.sha256(old.encode()).hexdigest(), rng.choice([1, 1, 1, 2]))
        rows.append((bytearray(data.encode()), *at))
    frame = spark.createDataFrame(rows, "content binary, size long, records long, hash string, version int")
    mode = reading_mode(F.col("content"), F.col("size"), F.col("hash"), F.col("records"), F.col("version"), 1)
    want = [(r["x"]["mode"], r["x"]["reason"]) for r in frame.select(mode.alias("x")).collect()]

    got = []
    for data, *at in rows:
        with tempfile.NamedTemporaryFile() as f:
            f.write(bytes(data))
            f.flush()
            found, _, _ = growing.Cursor(tuple(at), 1).read(f.name, len(data), 1 << 20)
        got.append((found["mode"], found["reason"]))
    assert got == want
