"""Streaming queries drained over the events table, against the batch result in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans.lineage import scratch_dir
from millrace.streaming import events as E

#: Longer than any disorder among the files of a table, so that no row of a table at rest counts as late.
WHOLE = "36500 days"


def _drained(make: Callable[[DataFrame], DataFrame], mode: str, keys: list[str] | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return E.drain(make(E.source(spark, sf_dir)), mode, f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}", keys)

    return run


QUERIES = {
    "stream_tumbling": (_drained(lambda e: E.tumbling(e, late=WHOLE), "complete"), "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"),
    "stream_sliding": (_drained(lambda e: E.sliding(e, late=WHOLE), "complete"), "WITH w AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - i * INTERVAL 15 MINUTE AS a FROM events, range(0, 4) AS r(i)) SELECT a, a + INTERVAL 1 HOUR AS b, count(*) AS n FROM w GROUP BY a"),
    "stream_totals": (_drained(lambda e: E.running_totals(e).select("user_id", "n", "total"), "update", ["user_id"]), "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id"),
    "stream_deduplicated": (_drained(lambda e: E.deduplicated(e, WHOLE).select("event_id", "user_id"), "append"), "SELECT event_id, user_id FROM events"),
    "stream_sessions": (_drained(lambda e: E.sessions(e, late=WHOLE), "complete"), "WITH f AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w > ts - INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM f) SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 30 MINUTE AS b, count(*) AS n FROM s GROUP BY user_id, k"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: q for n, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: o for n, (_, o) in QUERIES.items()}
