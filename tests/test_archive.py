"""Records: parsing gives back what was rendered, every error has its code, a scan accepts what lies where it should."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import archive

HASH = "sha256:" + "ab" * 32
NAMES = [x.split(" ")[0] for x in re.sub(r"<[^>]*>+", "", archive.RECORD).split(", ")]


def record(i=1, **more):
    second = {"normalizer_version": 3, "source_cursor_bytes": 90, "source_prefix_hash": HASH, "source_bytes": 90, "artifact_set_version": 2, "transcript_sha256": HASH, "extracted_outputs": [("cd" * 32, 7, "tool"), ("ef" * 32, 0, "user")], "project_component": "comp"}
    base = dict.fromkeys(NAMES) | {"schema_version": 2, "source": "codex", "session_id": f"s{i}", "project": "p", "project_identity": "id", "project_origin": "live", "completion_reason": "complete", "summary_revision": 1, "source_cursor": 4, "source_hash": HASH, "summary_placeholder": False, "tags": ["a", 'b "c"'], "title": "T", "goal": "one\n\ntwo", "work_completed": ["did"], "decisions": [], "files_changed": ["- x", "None."], "commands_and_validation": [], "open_items": []}
    return base | second | more


def made(rng, i):
    text = lambda: "".join(rng.choice(["a", "é", "𝒳", '"', "\\", ": ", "-", "#", "\t", "/", "日"]) for _ in range(rng.randint(1, 12))) + "."
    items = lambda least=0: [text() for _ in range(rng.randint(least, 3))]
    more = {"source": rng.choice(list(archive.AGENTS)), "project": text(), "project_identity": text(), "project_origin": rng.choice(archive.ORIGINS), "repository": rng.choice([None, text()]), "branch": rng.choice([None, ""]), "started_at": rng.choice([None, text()]), "completion_reason": rng.choice(archive.COMPLETIONS), "cursor_fallback_reason": rng.choice([None, *archive.FALLBACKS]), "summary_revision": rng.randint(1, 2**40), "summary_placeholder": rng.random() < 0.3, "tags": items(), "title": text(), "goal": text() + rng.choice(["", "\n", "\n- None.\n\nmore"]) + text(), "work_completed": items(1), **{x: items() for x in archive.LISTS if x != "work_completed"}}
    r = record(i, **more)
    if rng.random() < 0.4:
        r |= {"schema_version": 1, "project_component": "", **dict.fromkeys(("normalizer_version", "source_cursor_bytes", "source_prefix_hash", "source_bytes", "artifact_set_version", "transcript_sha256")), "extracted_outputs": []}
    return r


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(3)
    rows = [record(0), *(made(rng, i) for i in range(1, 300))]
    return spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rows], archive.RECORD)


def test_parse_gives_back_what_was_rendered(frame):
    texts = frame.select(archive.rendered().alias("markdown"))
    back = archive.parsed(texts)
    assert back.where("error is not null").count() == 0
    assert back.drop("error").exceptAll(frame).count() == 0 == frame.exceptAll(back.drop("error")).count()
    again = back.select(archive.rendered().alias("markdown"))
    assert again.exceptAll(texts).count() == 0


@pytest.fixture(scope="module")
def text(spark):
    return spark.createDataFrame([tuple(record()[n] for n in NAMES)], archive.RECORD).select(archive.rendered()).first()[0]


@pytest.mark.parametrize(
    "old,new,code",
    [
        ("---\nschema", "schema", "no-front-matter"),
        ("\n---\n\n", "\n---\n", "no-front-matter"),
        ("agent: ", "agent:", "bad-line"),
        ("tags:\n", "tags: x\n", "bad-line"),
        ('"s1"', "s1", "bad-string"),
        ("summary_revision: 1", "summary_revision: -1", "bad-number"),
        ("summary_revision: 1", "summary_revision: 0", "bad-revision"),
        ("summary_revision: 1\n", "", "missing-summary_revision"),
        ("source_bytes: 90\n", "", "missing-source_bytes"),
        ("source_bytes: 90", "source_bytes: 91", "bad-cursor"),
        ("source_cursor_records: 4", "source_cursor_records: 5", "bad-cursor"),
        ("normalizer_version: 3", "normalizer_version: 0", "bad-cursor"),
        ("schema_version: 2", "schema_version: 3", "bad-version"),
        ('"codex-cli"', '"codex"', "unknown-agent"),
        ('"codex:s1"', '"codex:s2"', "id-mismatch"),
        ('project: "p"', 'project: ""', "empty-project"),
        ('component: "comp"', 'component: "a/b"', "bad-component"),
        ('component: "comp"', 'component: ".."', "bad-component"),
        ('completion_reason: "complete"', 'completion_reason: "done"', "bad-completion"),
        ('project_identity: "id"', 'project_identity: "id"\nproject_origin: "guess"', "bad-origin"),
        ('project_identity: "id"', 'project_identity: "id"\ncursor_fallback_reason: "x"', "bad-fallback"),
        (f'source_hash: "{HASH}"', f'source_hash: "{HASH.upper()}"', "bad-hash"),
        (f'transcript_sha256: "{HASH}"', 'transcript_sha256: "sha256:1"', "bad-hash"),
        ("bytes:7", "bytes:x", "bad-output"),
        ("label:tool", "label:", "bad-output"),
        ("# T", "T", "bad-body"),
        ("## Decisions", "## Decision", "bad-body"),
        ("- did", "did", "bad-list"),
        ("# T", "# ", "invalid-summary"),
        ("- did", "- None.", "invalid-summary"),
        ("one\n\ntwo", "one\n## two", "invalid-summary"),
        ("tags:\n", "summary_placeholder: maybe\ntags:\n", "bad-flag"),
    ],
)
def test_errors(text, old, new, code):
    assert text.count(old) >= 1
    found = archive.parse_record(text.replace(old, new, 1))
    if code != "invalid-summary":
        assert found.get("error") == code
    else:
        assert "error" not in found


def test_summaries_are_validated_and_tags_tell_placeholders(spark, text):
    texts = [text, text.replace("# T", "# ", 1), text.replace("- did", "- None.", 1), text.replace("one\n\ntwo", "one\n## two", 1), text.replace('"a"', '"stand-in"', 1), "", None]
    rows = archive.parsed(spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, markdown string"), placeholder_tag="stand-in").orderBy("i").collect()
    assert [r["error"] for r in rows] == [None, *["invalid-summary"] * 3, None, "no-front-matter", "no-front-matter"]
    assert [r["summary_placeholder"] for r in rows[:5:4]] == [False, True]
    assert archive.parsed(spark.createDataFrame([], "i int, markdown string")).count() == 0


def test_scan_accepts_records_in_their_place(spark, frame, tmp_path):
    names = frame.withColumn("project_component", F.when(F.col("schema_version") == 1, "from-folder").otherwise(F.col("project_component")))
    where = names.select(archive.relative_path(F.col("source"), F.col("project_component"), F.col("session_id")).alias("relative_path"), "session_id")
    texts = frame.select("session_id", archive.rendered().alias("markdown")).join(where, "session_id").select("relative_path", "markdown")
    root = tmp_path / "records"
    assert archive.write_files(texts, str(root)).count() == 300
    assert not list(root.rglob("*.part"))
    again = archive.write_files(texts.limit(3), str(root)).collect()
    good, bad = archive.scan(spark, str(root))
    assert bad.count() == 0 and good.count() == 300
    assert good.where("schema_version = 1 and project_component <> 'from-folder'").count() == 0
    assert {r["markdown_hash"] for r in again} <= {r["markdown_hash"] for r in good.select("markdown_hash").collect()}
    one = next(root.rglob("s0.md"))
    (root / "elsewhere").mkdir()
    (root / "elsewhere/s0.md").write_text(one.read_text())
    (root / "broken.md").write_bytes(b"\xff\xfe")
    (root / "notes.md").write_text("hello")
    (root / "a/b/c/d").mkdir(parents=True)
    (root / "a/b/c/d/deep.md").write_text(one.read_text())
    good, bad = archive.scan(spark, str(root))
    assert good.count() == 300
    assert {tuple(r) for r in bad.collect()} == {("elsewhere/s0.md", "misplaced"), ("broken.md", "invalid-utf8"), ("notes.md", "no-front-matter")}
