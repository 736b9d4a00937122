"""A remote listing's pages, landed as JSON files, read as one table by following their cursors.

A folder holds a listing: pages `<cursor>.json`, the first one `first.json`, each
{"items": [...], "next": cursor or null}. Where a page is missing, isn't such an
object or leads back to one that was read, the listing ends with an error row,
never silently; one with more pages than the limit fails, as a cut listing would
look like a whole one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import opened

#: Items of a page at most, and pages of a listing.
PAGE_ITEMS, MOST_PAGES = 100, 10_000
FIRST = "first"
SCHEMA = "listing string, page bigint, position bigint, item string, error string"
#: Codes of an error row: the page isn't there, isn't a page, has too many items, or was read before.
MISSING, MALFORMED, OVERFULL, REPEATED = "missing-page", "malformed-page", "overfull-page", "repeated-cursor"


class TooManyPages(Exception):
    """A listing went on beyond the limit."""


class Listing(InputPartition):
    def __init__(self, name: str, folder: str):
        self.name, self.folder = name, folder


def _page(system: fs.FileSystem, path: str) -> tuple[list, str | None, str | None]:
    """(items, next cursor, error)."""
    try:
        with system.open_input_stream(path) as stream:
            found = json.loads(stream.read())
    except OSError:
        return [], None, MISSING
    except (ValueError, RecursionError):
        return [], None, MALFORMED
    if not isinstance(found, dict) or not isinstance(found.get("items"), list) or not isinstance(found.get("next"), str | None):
        return [], None, MALFORMED
    return found["items"], found.get("next"), OVERFULL if len(found["items"]) > PAGE_ITEMS else None


def follow(system: fs.FileSystem, folder: str, name: str, most_pages: int) -> Iterator[tuple]:
    """SCHEMA's rows of a listing in its order. One page leads to the next, so it is read by one task; a page is all that is held."""
    cursor, page, seen = FIRST, 0, set()
    while cursor is not None:
        if page >= most_pages:
            raise TooManyPages(f"listing {name}: more than {most_pages} pages")
        if cursor in seen:
            yield name, page, 0, None, REPEATED
            return
        if "/" in cursor or cursor in ("", ".", ".."):
            yield name, page, 0, None, MALFORMED
            return
        seen.add(cursor)
        items, after, error = _page(system, f"{folder}/{cursor}.json")
        if error:
            yield name, page, 0, None, error
            return
        for position, item in enumerate(items):
            yield name, page, position, json.dumps(item, separators=(",", ":"), ensure_ascii=False), None
        cursor, page = after, page + 1


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.most_pages = options["path"], int(options.get("mostPages", MOST_PAGES))

    def partitions(self) -> list[Listing]:
        """Each folder below the path is a listing of its own; without one the path itself is."""
        system, base = opened(self.path)
        folders = sorted(f.path for f in system.get_file_info(fs.FileSelector(base)) if f.type == fs.FileType.Directory)
        return [Listing(f.rsplit("/", 1)[-1], f) for f in folders] or [Listing(base.rstrip("/").rsplit("/", 1)[-1], base)]

    def read(self, partition: Listing) -> Iterator[tuple]:
        system, _ = opened(self.path)
        yield from follow(system, partition.folder, partition.name, self.most_pages)


class PagedListing(DataSource):
    """Format `paged_listing`: options path and mostPages."""

    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_listing(spark: SparkSession, path: str, most_pages: int = MOST_PAGES) -> DataFrame:
    """SCHEMA of all listings of a folder; `page` and `position` are an item's place."""
    spark.dataSource.register(PagedListing)
    return spark.read.format("paged_listing").option("mostPages", most_pages).load(path)


def listed_items(rows: DataFrame, schema: str) -> DataFrame:
    """Items as columns of the schema, with their place; error rows are left to `listing_errors`."""
    return rows.where("error is null").select("listing", "page", "position", F.from_json("item", schema).alias("x")).select("listing", "page", "position", "x.*")


def listing_errors(rows: DataFrame) -> DataFrame:
    return rows.where("error is not null").select("listing", "page", "error")
