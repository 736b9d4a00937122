"""Scalar functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"\p{IsWhite_Space}"


def nonempty(text: Column) -> Column:
    """Text without Unicode white space at its ends; null if nothing is left."""
    return F.nullif(F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", ""), F.lit(""))


def shortened(text: Column, n: int = 240) -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def slug(text: Column, n: int = 48) -> Column:
    """Lower-case letters and digits, each other character a dash, without dashes at the ends, then cut; `project` if nothing is left."""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(text), "(?s)[^a-z0-9]", "-"), "^-+|-+$", "")
    return F.substring(F.coalesce(F.nullif(dashed, F.lit("")), F.lit("project")), 1, n)


def component(identity: Column, name: Column) -> Column:
    """A folder name for a project: its slug and the start of its identity's hash."""
    return F.concat(slug(name), F.lit("-"), F.substring(F.sha2(identity, 256), 1, 12))


def project_label(name: Column, folder: Column, cwd: Column) -> Column:
    """The project's name, or its folder's without the hash, or the last part of the working directory."""
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(F.regexp_replace(folder, "^(.+)-[0-9a-f]{8,}$", "$1"), F.lit("")), F.element_at(F.split(cwd, "/"), -1))


def git_remote(url: Column) -> Column:
    """host/path of a git remote in either spelling, host in lower case, without user, default port and .git."""
    plain = F.regexp_replace(F.trim(url), r"(\.git)?/*$", "")
    scheme = F.regexp_extract(plain, r"^[a-z+]+://(?:[^@/]*@)?([^/:]+)(?::(?:22|443))?/(.+)$", 1)
    scp = F.regexp_extract(plain, r"^(?:[^@/]+@)?([^/:]+):(.+)$", 1)
    host = F.when(scheme != "", scheme).otherwise(scp)
    path = F.when(scheme != "", F.regexp_extract(plain, r"^[a-z+]+://[^/]+/(.+)$", 1)).otherwise(F.regexp_extract(plain, r"^[^/:]+:(.+)$", 1))
    return F.when(host != "", F.concat(F.lower(host), F.lit("/"), F.regexp_replace(path, "^/+", "")))


def dedupe_key(*parts: Column) -> Column:
    """A hash of the parts, each after its length in eight bytes."""
    def framed(p: Column) -> Column:
        return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(p)), 16, "0")), F.encode(p, "UTF-8"))

    return F.sha2(F.concat(*map(framed, parts)), 256)


def size_text(n: Column) -> Column:
    """Bytes as B, KB, MB or GB with one decimal."""
    forms = [F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))]
    for k, unit in enumerate(("KB", "MB"), 1):
        forms.append(F.when(n < 1024 ** (k + 1), F.format_string(f"%.1f {unit}", n / 1024**k)))
    return F.coalesce(*forms, F.format_string("%.1f GB", n / 1024**3))
