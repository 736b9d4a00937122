"""Content-addressed outputs: elision, deduplication, lookup, line search, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ELIDE_OVER = 131_072


def claim_ticket(sha256: Column, size: Column, label: Column, mark: str = "claim-ticket") -> Column:
    """The line that stands for an output kept elsewhere."""
    return F.concat(F.lit(f"[{mark} sha256:"), sha256, F.lit(" bytes:"), size.cast("string"), F.lit(" label:"), label, F.lit("]"))


def elided(outputs: DataFrame, over: int = ELIDE_OVER) -> DataFrame:
    """Outputs of more than `over` bytes as tickets; the others keep their content."""
    ticket = F.when(F.col("bytes") > over, claim_ticket(F.col("sha256"), F.col("bytes"), F.col("label")))
    return outputs.select("seq", "bytes", ticket.isNotNull().alias("elided"), ticket.alias("ticket"))


def distinct_outputs(outputs: DataFrame, over: int = ELIDE_OVER) -> DataFrame:
    """Each large output once, by its hash, under its first label; only hashes are shuffled, not contents."""
    large = outputs.where(F.col("bytes") > over).select("sha256", "seq", "label", "bytes")
    return large.groupBy("sha256").agg(F.min_by("label", "seq").alias("label"), F.min("bytes").alias("bytes"), F.min("seq").alias("first_seq"), F.count("*").alias("copies"))


def normalized_hash(text: Column) -> Column:
    """64 lower-case hex digits, an optional sha256: before them cut off; null for anything else."""
    bare = F.regexp_replace(text, "^sha256:", "")
    return F.when(bare.rlike("^[0-9a-f]{64}$"), bare)


def prefixed(digest: Column) -> Column:
    """A digest with its algorithm before it, once."""
    return F.when(digest.startswith("sha256:"), digest).otherwise(F.concat(F.lit("sha256:"), digest))


def packed_hash(text: Column) -> Column:
    """The text as bytes, for shuffles: `sha256:` and 64 lower-case hex digits as the digest's 32 bytes; any other text after 33 zero bytes, so that none is taken for a digest."""
    # what isn't hexadecimal gives null; a regular expression doubles the time
    digest = F.when(text.startswith("sha256:") & (F.octet_length(text) == 71) & (F.lower(text) == text), F.unhex(F.substring(text, 8, 64)))
    return F.coalesce(digest, F.concat(F.lit("\0" * 33), text).cast("binary"))


def unpacked_hash(packed: Column) -> Column:
    """The text that `packed_hash` packed."""
    digest = F.concat(F.lit("sha256:"), F.lower(F.hex(packed)))
    return F.when(F.octet_length(packed) == 32, digest).otherwise(F.substring(packed, 34, 2**31 - 1).cast("string"))


def redeemed(tickets: DataFrame, outputs: DataFrame) -> DataFrame:
    """Outputs that match the tickets' hashes; a hash may match several."""
    wanted = tickets.select(normalized_hash(F.col("sha256")).alias("sha256")).where("sha256 is not null").distinct()
    return outputs.select("sha256", "seq", "label", "bytes").join(wanted, "sha256")


def line_search(outputs: DataFrame, query: str, context: int = 2) -> DataFrame:
    """(seq, first_line, last_line, matches): matching lines, letter case aside, with their context, those that touch merged. Lines count from 0.

    Windows are over one text's matching lines.
    """
    hit = F.filter(F.transform(F.col("lines"), lambda x, i: F.when(F.contains(F.lower(x), F.lit(query.lower())), i)), lambda i: i.isNotNull())
    lines = outputs.where(F.contains(F.lower("content"), F.lit(query.lower()))).select("seq", F.split(F.regexp_replace("content", r"\r?\n\z", ""), "\r?\n").alias("lines"))
    at = lines.select("seq", F.size("lines").alias("n"), F.explode(hit).alias("at"))
    spans = at.select("seq", "at", F.greatest(F.col("at") - context, F.lit(0)).alias("a"), F.least(F.col("at") + context, F.col("n") - 1).alias("b"))
    by = Window.partitionBy("seq").orderBy("at")
    before = F.max("b").over(by.rowsBetween(Window.unboundedPreceding, -1))
    groups = spans.withColumn("new", F.when(F.col("a") <= before + 1, 0).otherwise(1)).withColumn("island", F.sum("new").over(by))
    return groups.groupBy("seq", "island").agg(F.min("a").cast("long").alias("first_line"), F.max("b").cast("long").alias("last_line"), F.count("*").alias("matches")).drop("island")


def manifest_hash(entries: DataFrame, key: str, path: str, digest: str, size: str) -> DataFrame:
    """A hash of each key's entries in the order of their paths."""
    line = F.concat(F.col(digest), F.lit("  "), F.col(size).cast("string"), F.lit("  "), F.col(path), F.lit("\n"))
    lines = F.array_sort(F.collect_list(F.struct(F.col(path).alias("p"), line.alias("line"))))
    return entries.groupBy(key).agg(F.sha2(F.array_join(F.transform(lines, lambda x: x["line"]), ""), 256).alias("manifest_hash"), F.count("*").alias("files"))


def key_frequencies(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """How many JSON objects have each top-level key."""
    return lines.select(F.explode(F.json_object_keys(raw)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def known_records(artifacts: DataFrame, records: DataFrame) -> DataFrame:
    """Artifacts with the local record that has their content, null where none has: by the hash, with or without its prefix; of equal records the last by path.

    Both sides are joined by the hash, packed, as it is most of what is shuffled; neither is held by one task.
    """

    def hashed(rows: DataFrame, c: str) -> DataFrame:
        return rows.withColumn("hash_", prefixed(F.col(c))).withColumn("hash_", packed_hash(F.col("hash_")))

    index = hashed(records, "markdown_hash").groupBy("hash_").agg(F.max("relative_path").alias("local_path"))
    return hashed(artifacts, "original_sha256").join(index, "hash_", "left").drop("hash_")
