"""Queries of tool calls over a projection of `events`, each with its DuckDB oracle.

The oracle goes through a session's events one at a time, with a list of waiting
calls, which is another way than the operator's running counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyspark.operators import calls

from . import catalog
from .catalog import query
from .views import with_views

_PAIRS = f"""WITH RECURSIVE views AS (SELECT 1), {with_views('', 'tool_events').strip().removeprefix('WITH ')},
named AS (SELECT *, row_number() OVER (PARTITION BY session_id, call_id ORDER BY seq) AS i FROM v_tool_events WHERE call_id IS NOT NULL),
walk AS (
  SELECT session_id, call_id, 0::BIGINT AS i, []::BIGINT[] AS waiting, NULL::BIGINT AS call_seq, NULL::BIGINT AS result_seq FROM (SELECT DISTINCT session_id, call_id FROM named)
  UNION ALL
  SELECT w.session_id, w.call_id, n.i, CASE WHEN n.phase = 'call' THEN list_append(w.waiting, n.seq) ELSE w.waiting[2:] END, CASE WHEN n.phase = 'result' THEN w.waiting[1] END, CASE WHEN n.phase = 'result' THEN n.seq END
  FROM walk w JOIN named n ON n.session_id = w.session_id AND n.call_id = w.call_id AND n.i = w.i + 1),
ends AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY session_id, call_id ORDER BY i DESC) = 1),
times AS (SELECT session_id, call_id, count(*) FILTER (WHERE phase = 'call') > 1 OR count(*) FILTER (WHERE phase = 'result') > 1 AS repeated FROM named GROUP BY 1, 2),
found AS (SELECT session_id, call_id, call_seq, result_seq FROM walk WHERE result_seq IS NOT NULL UNION ALL SELECT session_id, call_id, unnest(waiting), NULL FROM ends),
pairs AS (
  SELECT session_id, call_id, call_seq, result_seq, repeated FROM found JOIN times USING (session_id, call_id)
  UNION ALL SELECT session_id, NULL, CASE WHEN phase = 'call' THEN seq END, CASE WHEN phase = 'result' THEN seq END, false FROM v_tool_events WHERE call_id IS NULL),
told AS (SELECT *, CASE WHEN call_seq IS NULL THEN 'no-call' WHEN result_seq IS NULL THEN 'unanswered' ELSE 'answered' END AS status FROM pairs)"""

query("j12_paired_calls", None, "tool_events")(calls.paired)
catalog.ORACLE["j12_paired_calls"] = f"{_PAIRS} SELECT session_id, call_id, call_seq, result_seq, status, repeated FROM told"


@query("j12_pairing_totals", None, "tool_events")
def _(e: DataFrame) -> DataFrame:
    return calls.pairing_totals(calls.paired(e))


catalog.ORACLE["j12_pairing_totals"] = f"{_PAIRS} SELECT status, count(*)::BIGINT AS n, (count(*) FILTER (WHERE repeated))::BIGINT AS n_repeated, max(result_seq - call_seq)::BIGINT AS longest FROM told GROUP BY status"
