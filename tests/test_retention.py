"""Facts of tool events on small rows with the cases the test tables lack."""

import re

from pyspark.sql import functions as F

from tallyspark.operators import retention


def plain_failures(text):
    out = []
    for m in re.finditer(retention.FAILURE, text[: retention.SCANNED]):
        x = re.sub(r"\s+", " ", text[: retention.SCANNED][m.start() : m.start() + retention.FRAGMENT]).strip()
        if len(x) > retention.SHORT:
            out.append(x)
    return out


def test_failures(spark):
    texts = [
        "error: cannot find it",
        "x\nerror[E0308]: mismatched types here and there and on and on and on until it is cut",
        "a::HttpError: no\nuse thiserror: no\nMyError: yes it did fail",
        "\n\n  \n TypeError : spaced out\nFAILED tests/a.py::b\nFAIL\nFAILURE is not one",
        "panicked at 'x'\nno such file or directory\n" + "y" * 9000 + "\nerror: too late to be seen",
        "Error: é" + "\nException: " * 5,
        "",
        None,
    ]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").orderBy("i").select(retention.failures(F.col("t"))).collect()]
    assert got[:-1] == [plain_failures(x) for x in texts[:-1]] and got[-1] is None
    assert sum(map(len, got[:-1])) >= 7


def test_facts_are_sets_and_only_of_changes(spark):
    rows = [("s", "Edit", {"file_path": "/a/b.py"}, None), ("s", "Write", {"file_path": "/c/b.py"}, None), ("s", "NotebookEdit", {"file_path": "", "notebook_path": "n.ipynb"}, None), ("s", "Read", {"file_path": "/a/read.py"}, None), ("s", "Edit", {}, None), ("s", "Bash", {"command": "  git   commit -m x"}, None), ("s", "Bash", {"command": " "}, None), ("s", "Bash", {"command": "ls"}, None), ("t", "Bash", None, "FAILED because"), ("t", None, None, None)]
    frame = spark.createDataFrame(rows, "session_id string, tool string, arguments map<string,string>, result string")
    got = {tuple(r) for r in retention.facts(frame).collect()}
    assert got == {("s", "files_modified", "b.py"), ("s", "files_modified", "n.ipynb"), ("s", "commands", "git commit"), ("s", "commands", "ls"), ("t", "errors", "FAILED because")}
    summaries = spark.createDataFrame([("s", "Changed B.PY and ran Git  commit"), ("s", None), ("u", "x")], "session_id string, summary string")
    kept = retention.kept_facts(retention.facts(frame), summaries)
    assert {tuple(r)[1:] for r in kept.collect()} == {("files_modified", "b.py", True, False), ("files_modified", "n.ipynb", False, False), ("commands", "git commit", False, True), ("commands", "ls", False, False)}
    assert {tuple(r) for r in retention.totals(kept).collect()} == {("files_modified", 2, 1, 0, 50.0, 0.0), ("commands", 2, 0, 1, 0.0, 50.0), ("errors", 0, 0, 0, None, None)}
    assert retention.totals(kept.where("false")).count() == 3
