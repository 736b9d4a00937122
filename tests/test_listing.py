"""Listings of many pages: all rows in order, errors as rows, and a limit that fails."""

import json

import pytest

from tallyspark.sources import listing


def land(folder, pages, cursors=None):
    folder.mkdir(parents=True)
    names = ["first", *(cursors or [f"c{i}" for i in range(1, len(pages))])]
    for i, items in enumerate(pages):
        (folder / f"{names[i]}.json").write_text(json.dumps({"items": items, "next": names[i + 1] if i + 1 < len(names) else None}))


def test_listings(spark, tmp_path):
    items = [{"id": i, "name": f"n{i} é"} for i in range(230)]
    land(tmp_path / "in/whole", [items[i : i + 100] for i in range(0, 230, 100)])
    land(tmp_path / "in/empty", [[]])
    land(tmp_path / "in/lost", [[1, 2], [3]], ["c1", "gone"])
    land(tmp_path / "in/round", [[1], [2]], ["c1", "first"])
    land(tmp_path / "in/broken", [["a"], ["b"]])
    (tmp_path / "in/broken/c1.json").write_text('{"items": [1')
    land(tmp_path / "in/overfull", [list(range(101))])
    land(tmp_path / "in/escape", [[1]], ["../whole/first"])
    rows = listing.read_listing(spark, str(tmp_path / "in"))
    assert {tuple(r) for r in listing.listing_errors(rows).collect()} == {("lost", 2, "missing-page"), ("round", 2, "repeated-cursor"), ("broken", 1, "malformed-page"), ("overfull", 0, "overfull-page"), ("escape", 1, "malformed-page")}
    whole = listing.listed_items(rows.where("listing = 'whole'"), "id long, name string").orderBy("page", "position").collect()
    assert [{"id": r["id"], "name": r["name"]} for r in whole] == items
    assert {r["listing"]: r["n"] for r in rows.where("error is null").groupBy("listing").count().withColumnRenamed("count", "n").collect()} == {"whole": 230, "lost": 3, "round": 2, "broken": 1, "escape": 1}
    assert listing.read_listing(spark, str(tmp_path / "in/lost")).count() == 4


def test_too_many_pages_fail(spark, tmp_path):
    land(tmp_path / "in", [[i] for i in range(5)])
    assert listing.read_listing(spark, str(tmp_path / "in"), 5).count() == 5
    with pytest.raises(Exception, match="more than 4 pages"):
        listing.read_listing(spark, str(tmp_path / "in"), 4).count()
