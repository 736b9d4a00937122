"""How much of a session's facts its summary keeps.

Facts are what a session changed, ran and saw fail: sets per session. A fact is
kept by `prefix` if the summary holds its beginning, by `distinctive` if it
holds one of its telling words. The first is a floor, as beginnings are
phrased anew; the second a ceiling, as a word may be there by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tools that change files, with the argument that names one; the tool that runs commands.
EDITORS = {"Edit": "file_path", "Write": "file_path", "NotebookEdit": "notebook_path"}
SHELL = "Bash"
#: Characters of a result that are looked at, of an error's text, of a fact's beginning; an error's text has more characters than SHORT.
SCANNED, FRAGMENT, BEGINNING, SHORT = 8192, 70, 40, 12
#: What a failure looks like at the start of a line, and what a word is.
FAILURE = r"(?:^|\n)\s*(?:error(?:\[[A-Z]\d+\])?\s*:|(?:[A-Z][A-Za-z]*)?(?:Error|Exception)\s*:|panicked at|FAILED\b|FAIL\b|no such file or directory)"
WORD = r"[A-Za-z_][A-Za-z0-9_]{4,}"
#: Words that tell nothing.
COMMON = (
    "error fail failed could not compile test tests due to previous errors rerun pass the and of in on at is no such file directory type types annotations needed mismatched expected"
    " but was src lib crates value values found this that with from"
).split()
CATEGORIES = ("files_modified", "commands", "errors")


def changed_file(tool: Column, arguments: Column) -> Column:
    """The name of the file that a tool call changes; arguments is a map. Files that are only read are no facts."""
    path = F.coalesce(F.nullif(arguments["file_path"], F.lit("")), F.nullif(arguments["notebook_path"], F.lit("")))
    return F.when(tool.isin(*EDITORS) & path.isNotNull(), F.regexp_extract(path, r"([^/]*)\z", 1))


def command(tool: Column, arguments: Column) -> Column:
    """The first two words of the command that a tool call runs."""
    words = F.filter(F.split(arguments["command"], r"\s+"), lambda x: x != "")
    return F.when((tool == SHELL) & (F.size(words) > 0), F.array_join(F.slice(words, 1, 2), " "))


def failures(result: Column) -> Column:
    """The texts of failures in a tool's result, each from its line's start, white space squeezed; an array."""
    seen = F.substring(result, 1, SCANNED)
    # the text is looked at ahead, so that a match takes no more than what tells it
    found = F.regexp_extract_all(seen, F.lit(rf"(?=([\s\S]{{1,{FRAGMENT}}})){FAILURE}"), F.lit(1))
    squeezed = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, r"\s+", " "), "^ | $", ""))
    return F.filter(squeezed, lambda x: F.char_length(x) > SHORT)


def facts(events: DataFrame) -> DataFrame:
    """(session_id, category, fact), each once, of tool events (session_id, tool, arguments: map, result: text).

    A row is a call (tool and arguments) or a result; nulls say nothing. Rows
    that repeat count once. Sets are made by partial aggregation; no session's
    facts are gathered.
    """
    tool, arguments = F.col("tool"), F.col("arguments")
    found = F.array(
        F.struct(F.lit("files_modified").alias("category"), F.array(changed_file(tool, arguments)).alias("facts")),
        F.struct(F.lit("commands").alias("category"), F.array(command(tool, arguments)).alias("facts")),
        F.struct(F.lit("errors").alias("category"), F.coalesce(failures(F.col("result")), F.array().cast("array<string>")).alias("facts")),
    )
    rows = events.select("session_id", F.explode(found).alias("x")).select("session_id", "x.category", F.explode("x.facts").alias("fact"))
    return rows.where("fact is not null").distinct()


def distinctive_words(fact: Column) -> Column:
    """A fact's words that tell something, in small letters, each once."""
    words = F.transform(F.regexp_extract_all(fact, F.lit(f"({WORD})"), F.lit(1)), F.lower)
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*COMMON)))


def kept_facts(found: DataFrame, summaries: DataFrame) -> DataFrame:
    """(session_id, category, fact, prefix, distinctive) of facts of sessions that have a summary (session_id, summary).

    Facts meet their own session's summary only, by one join on the session;
    a session with several summaries counts by its smallest text, one with none
    is left out.
    """
    texts = summaries.where("summary is not null").groupBy("session_id").agg(F.lower(F.min("summary")).alias("text"))
    rows = found.join(texts, "session_id")
    prefix = F.col("text").contains(F.substring(F.lower("fact"), 1, BEGINNING))
    distinctive = F.exists(distinctive_words(F.col("fact")), lambda w: F.col("text").contains(w))
    return rows.select("session_id", "category", "fact", prefix.alias("prefix"), distinctive.alias("distinctive"))


def by_session(kept: DataFrame) -> DataFrame:
    """(session_id, category, total, prefix, distinctive)."""
    return kept.groupBy("session_id", "category").agg(*_counts())


def totals(kept: DataFrame) -> DataFrame:
    """(category, total, prefix, distinctive, prefix_percent, distinctive_percent), a row for each category; percentages to a tenth, null without facts."""
    counts = kept.groupBy("category").agg(*_counts())
    every = kept.sparkSession.createDataFrame([(x,) for x in CATEGORIES], "category string")
    rows = every.join(F.broadcast(counts), "category", "left").na.fill(0, ["total", "prefix", "distinctive"])
    percent = lambda c: F.when(F.col("total") > 0, F.round(100 * F.col(c) / F.col("total"), 1)).alias(f"{c}_percent")
    return rows.select("category", "total", "prefix", "distinctive", percent("prefix"), percent("distinctive"))


def _counts() -> tuple[Column, ...]:
    return F.count("*").alias("total"), F.count_if("prefix").alias("prefix"), F.count_if("distinctive").alias("distinctive")


def word_index(found: DataFrame) -> DataFrame:
    """(word, category, facts, sessions): how many facts and sessions of each category a telling word is of."""
    rows = found.select("session_id", "category", "fact", F.explode(distinctive_words(F.col("fact"))).alias("word"))
    return rows.groupBy("word", "category").agg(F.count("*").alias("facts"), F.count_distinct("session_id").alias("sessions"))
