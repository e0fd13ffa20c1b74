"""Queries over the event ledger, as streams run to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.plans.knowledge import snapshot_signals
from ledgerloom.sources.tables import table
from ledgerloom.streaming import ledgers


def _stream(s, d):
    """Events with ``ts`` read as UTC, whatever the session's zone: watermarks need an instant."""
    shifted = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts"))
    return ledgers.event_stream(s, d, "events", table(s, d, "events").schema).withColumn("ts", shifted.cast("timestamp"))


def _plain(c):
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col(c).cast("timestamp_ntz"))


def stream_tumbling(s, d):
    return ledgers.settle(ledgers.tumbling(_stream(s, d), "ts", "1 day", "event_type")).withColumn("start", _plain("start"))


def stream_sliding(s, d):
    return ledgers.settle(ledgers.sliding(_stream(s, d), "ts", "2 hours", "1 hour", "event_type")).withColumn("start", _plain("start"))


def event_sessions(s, d):
    """Sessions over the stored ledger."""
    return ledgers.sessions(table(s, d, "events"), "ts", "6 hours", "user_id")


def stream_first_writes(s, d):
    """One event per user: the state is bounded by a watermark wider than the data."""
    rows = ledgers.settle(ledgers.first_writes(_stream(s, d).select("event_id", "ts", "event_type"), "event_id", "ts", "400 days"), "append")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def event_props(s, d):
    """The JSON properties of events by type."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    return table(s, d, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"), F.max(k).alias("top"))


def signal_gate(s, d):
    return ledgers.regression_gate(snapshot_signals(s, d).select("snapshot", "n_flagged", "n_unhashed"), "snapshot", ("n_flagged", "n_unhashed"))


QUERIES = {f.__name__: f for f in (stream_tumbling, stream_sliding, event_sessions, stream_first_writes, event_props, signal_gate)}

_FLAGGED = "('permission-revoked', 'deleted-from-origin', 'do-not-use', 'revoked')"
SQL = {
    "stream_tumbling": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "stream_sliding": "SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY 1, 2",
    "event_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS end, count(*) AS n FROM s GROUP BY user_id, k",
    "stream_first_writes": "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1",
    "event_props": "SELECT event_type, count(k) AS n, sum(k)::BIGINT AS total, max(k) AS top FROM (SELECT event_type, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY 1",
    "signal_gate": f"SELECT snapshot, n_flagged, n_unhashed, coalesce(n_flagged > lag(n_flagged) OVER w, false) OR coalesce(n_unhashed > lag(n_unhashed) OVER w, false) AS regressed FROM (SELECT snapshot, count(DISTINCT id) FILTER (WHERE lower(trim(source_status)) IN {_FLAGGED}) AS n_flagged, count(DISTINCT id) FILTER (WHERE content_hash IS NULL) AS n_unhashed FROM snapshot_state WHERE snapshot IS NOT NULL GROUP BY 1) WINDOW w AS (ORDER BY snapshot)",
}
