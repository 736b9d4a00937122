"""Queries of retention over a projection of `documents`, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators import retention

from .catalog import query

_COMMON = ", ".join(f"'{x}'" for x in retention.COMMON)


def _facts(t: DataFrame) -> DataFrame:
    arguments = F.create_map(F.lit("file_path"), F.col("path"), F.lit("notebook_path"), F.col("notebook"), F.lit("command"), F.col("command"))
    return retention.facts(t.select("session_id", "tool", arguments.alias("arguments"), "result"))


# a failure's match: at the text's start or a line's, not inside the white space that one before it goes through
_FAILURE = retention.FAILURE.removeprefix(r"(?:^|\n)")
_SQL = rf""", places AS (SELECT session_id, seen, unnest(range(0, length(seen))) AS pos FROM (SELECT session_id, left(result, {retention.SCANNED}) AS seen FROM v_tool_texts WHERE result IS NOT NULL)),
starts AS (SELECT *, substr(seen, pos + 1) AS rest, left(seen, pos) AS before FROM places WHERE pos = 0 OR substr(seen, pos + 1, 1) = chr(10)),
failed AS (SELECT session_id, trim(regexp_replace(left(rest, {retention.FRAGMENT}), '\s+', ' ', 'g')) AS fact FROM starts
  WHERE (regexp_matches(rest, '^\n{_FAILURE}') OR (pos = 0 AND regexp_matches(rest, '^{_FAILURE}'))) AND (pos = 0 OR NOT regexp_matches(before, '(^|\n)\s*$'))),
named AS (
  SELECT session_id, 'files_modified' AS category, regexp_extract(coalesce(nullif(path, ''), nullif(notebook, '')), '([^/]*)$', 1) AS fact FROM v_tool_texts WHERE tool IN ('Edit', 'Write', 'NotebookEdit') AND coalesce(nullif(path, ''), nullif(notebook, '')) IS NOT NULL
  UNION ALL SELECT session_id, 'commands', array_to_string(regexp_extract_all(command, '\S+')[1:2], ' ') FROM v_tool_texts WHERE tool = 'Bash' AND regexp_matches(command, '\S')
  UNION ALL SELECT session_id, 'errors', fact FROM failed WHERE length(fact) > {retention.SHORT}),
facts AS (SELECT DISTINCT * FROM named),
words AS (SELECT *, list_distinct(list_filter([lower(w) FOR w IN regexp_extract_all(fact, '{retention.WORD}')], lambda w: w NOT IN ({_COMMON}))) AS ws FROM facts),
summaries AS (SELECT session_id, lower(min(summary)) AS summary FROM v_tool_texts WHERE summary IS NOT NULL GROUP BY 1),
kept AS (SELECT session_id, category, fact, contains(summary, left(lower(fact), {retention.BEGINNING})) AS prefix, len(list_filter(ws, lambda w: contains(summary, w))) > 0 AS distinctive FROM words JOIN summaries USING (session_id))"""


@query("a31_facts", f"{_SQL} SELECT session_id, category, fact FROM facts", "tool_texts")
def _(t: DataFrame) -> DataFrame:
    return _facts(t)


@query("j11_kept_facts", f"{_SQL} SELECT * FROM kept", "tool_texts")
def _(t: DataFrame) -> DataFrame:
    return retention.kept_facts(_facts(t), t.select("session_id", "summary"))


@query(
    "a29_retention",
    f"{_SQL} SELECT category, total, prefix, distinctive, CASE WHEN total > 0 THEN round(100 * prefix / total, 1) END AS prefix_percent, CASE WHEN total > 0 THEN round(100 * distinctive / total, 1) END AS distinctive_percent"
    " FROM (SELECT category, count(fact)::BIGINT AS total, (count(*) FILTER (WHERE prefix))::BIGINT AS prefix, (count(*) FILTER (WHERE distinctive))::BIGINT AS distinctive FROM (SELECT unnest(['files_modified', 'commands', 'errors']) AS category) LEFT JOIN kept USING (category) GROUP BY 1)",
    "tool_texts",
)
def _(t: DataFrame) -> DataFrame:
    return retention.totals(retention.kept_facts(_facts(t), t.select("session_id", "summary")))


@query("j11_word_index", f"{_SQL} SELECT word, category, count(*)::BIGINT AS facts, count(DISTINCT session_id)::BIGINT AS sessions FROM (SELECT session_id, category, fact, unnest(ws) AS word FROM words) GROUP BY 1, 2", "tool_texts")
def _(t: DataFrame) -> DataFrame:
    return retention.word_index(_facts(t))
