"""Queries that run streams over the event table, part by part with a restart between parts, and
the SQL that says what they must add up to."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contaflux.operators import audit
from contaflux.plans.base import ORACLES, add, add_raw
from contaflux.plans.domain import sql
from contaflux.sources.shared import kept
from contaflux.streaming import joins, state

_PARTS = 3
_LOG = "concat('{\"event_id\":', event_id, ',\"event_type\":\"', event_type, '\"}')"


def _logged(e: DataFrame) -> DataFrame:
    return e.select("user_id", "ts", "event_id", F.expr(_LOG).alias("payload"))


add_raw("stm_08_flagged", "events", lambda e: state.advanced(e, _PARTS, "ts", lambda rows: state.flagged(rows, "user_id", 3, ["ts", "event_id"])), "SELECT user_id, ts, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 3")
add_raw("stm_09_chained", "events", lambda e: state.advanced(_logged(e), _PARTS, "ts", lambda rows: state.chained(rows, "user_id", ["ts", "event_id"])), f"""WITH RECURSIVE rows AS MATERIALIZED (SELECT user_id, ts, event_id, {_LOG} AS payload, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
chain AS (SELECT user_id, ts, event_id, n, '' AS previous, sha256(payload) AS hash FROM rows WHERE n = 1
UNION ALL SELECT r.user_id, r.ts, r.event_id, r.n, c.hash, sha256(concat(c.hash, r.payload)) FROM chain c JOIN rows r ON r.user_id = c.user_id AND r.n = c.n + 1)
SELECT user_id, ts, event_id, n, previous, hash FROM chain""")  # fmt: skip

# Grants are sign-ups and views, uses are clicks of the same user and hour of the day.
_TOKENS = "SELECT concat(user_id, '/', hour(ts)) AS key, event_id AS id, ts, event_type = 'click' AS use FROM events WHERE event_type IN ('signup', 'view', 'click')"


def _tokens(e: DataFrame) -> DataFrame:
    rows = e.where(F.col("event_type").isin("signup", "view", "click"))
    return rows.select(F.concat("user_id", F.lit("/"), F.hour("ts")).alias("key"), F.col("event_id").alias("id"), "ts", (F.col("event_type") == "click").alias("use"))


add_raw("stm_07_once_used", "events", lambda e: state.advanced(_tokens(e), _PARTS, "ts", lambda rows: state.once_used(rows, datetime.timedelta(days=2))), f"""WITH t AS (SELECT *, lag(id) OVER k AS last_id, lag(ts) OVER k AS last_ts, lag(use) OVER k AS last_use, lead(ts) OVER k AS next_ts, lead(use) OVER k AS next_use FROM ({_TOKENS}) WINDOW k AS (PARTITION BY key ORDER BY ts, id))
SELECT key, CASE WHEN NOT last_use AND ts <= last_ts + INTERVAL 2 DAY THEN last_id END AS grant_id, id AS use_id, CASE WHEN NOT last_use AND ts <= last_ts + INTERVAL 2 DAY THEN 'used' ELSE 'refused' END AS outcome FROM t WHERE use
UNION ALL SELECT key, id, NULL, CASE WHEN next_ts <= ts + INTERVAL 2 DAY THEN 'replaced' ELSE 'unused' END FROM t
WHERE NOT use AND CASE WHEN next_ts IS NULL THEN epoch_us(ts + INTERVAL 2 DAY) // 1000 + 1 <= (SELECT epoch_us(max(ts) - INTERVAL 10 MINUTE) // 1000 FROM t) ELSE NOT next_use OR next_ts > ts + INTERVAL 2 DAY END""")  # fmt: skip


def _of(e: DataFrame, kind: str) -> DataFrame:
    return e.where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias("id"), "ts")


def _joined(e: DataFrame) -> DataFrame:
    """Purchases within two hours of a view, both from one stream of events that is read twice."""
    found = state.advanced(e.select("user_id", "event_id", "event_type", "ts"), _PARTS, "ts", lambda rows: joins.interval_join(_of(rows, "view"), _of(rows, "purchase"), "user_id", "2 hours"))
    return found.select("user_id", "left_id", "right_id", F.col("right_ts").cast("timestamp_ntz").alias("at"))


add_raw("stm_13_interval_join", "events", _joined, "SELECT v.user_id, v.event_id AS left_id, p.event_id AS right_id, p.ts AS at FROM events v JOIN events p ON p.user_id = v.user_id AND p.ts BETWEEN v.ts AND v.ts + INTERVAL 2 HOUR WHERE v.event_type = 'view' AND p.event_type = 'purchase'")

# An event arrives up to four days after it happened, in three parts.
_ARRIVAL = "CASE WHEN ts + (event_id % 5) * INTERVAL 1 DAY < TIMESTAMP '2024-01-11' THEN 0 WHEN ts + (event_id % 5) * INTERVAL 1 DAY < TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END"


def _late(e: DataFrame) -> DataFrame:
    rows = e.withColumn("part", F.expr(_ARRIVAL.replace("TIMESTAMP '", "TIMESTAMP_NTZ '")))
    main, late = joins.late_of([rows.where(F.col("part") == i) for i in range(_PARTS)], "1 day")
    both = main.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))
    return both.groupBy("part", "event_type", "late").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


add_raw("stm_13_late_rows", "events", _late, f"""WITH t AS (SELECT *, {_ARRIVAL} AS part FROM events), tops AS (SELECT part, max(ts) AS top FROM t GROUP BY part)
SELECT part, event_type, late, count(*) AS n, min(event_id) AS first FROM (SELECT t.*, coalesce(t.ts < (SELECT max(top) FROM tops WHERE tops.part < t.part) - INTERVAL 1 DAY, false) AS late FROM t) GROUP BY part, event_type, late""")
add_raw("snk_08_ingested", "events", lambda e: state.ingested(e.select("user_id", "event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "ts").withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz")), _PARTS, "ts", ["user_id", "event_type", "day"]).select("user_id", "event_type", "day"), "SELECT DISTINCT user_id, event_type, date_trunc('day', ts) AS day FROM events")

# A log that was tampered with: payloads changed, rows taken out.
_CHANGED, _TAKEN = "id % 101 = 7", "id % 503 = 11"


def _log(rows: DataFrame) -> DataFrame:
    return rows.withColumn("payload", audit.payload("action", "id", "user_id"))


def _tampered(rows: DataFrame) -> DataFrame:
    log = _log(rows)
    whole = log.join(audit.appended(log), ["tenant_id", "id"]).select("tenant_id", "id", "created_at", "payload", "prev_hash", "row_hash")
    return kept(whole.where(f"NOT ({_TAKEN})").withColumn("payload", F.when(F.expr(_CHANGED), F.concat("payload", F.lit(" "))).otherwise(F.col("payload"))), "log")


_PAYLOAD = "concat('{\"action\":\"', action, '\",\"id\":', id, ',\"user_id\":', user_id, '}')"
_LINKS = f"""SELECT *, {_CHANGED} OR coalesce(lag({_TAKEN}) OVER (PARTITION BY tenant_id ORDER BY created_at, id), false) AS bad FROM audit"""
add("win_01_chain_verify", "audit", lambda a: audit.verified(_tampered(a)), f"SELECT tenant_id, count(*) AS n, count_if(bad) AS broken, arg_min(id, (created_at, id)) FILTER (bad) AS first_broken FROM ({_LINKS}) WHERE NOT ({_TAKEN}) GROUP BY tenant_id")
add("win_02_chain_append", "audit", lambda a: audit.appended(_log(a)))
ORACLES["win_02_chain_append"] = f"""WITH RECURSIVE {sql("audit")}, rows AS MATERIALIZED (SELECT tenant_id, id, {_PAYLOAD} AS payload, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at, id) AS n FROM audit),
chain AS (SELECT tenant_id, id, n, CAST(NULL AS VARCHAR) AS prev_hash, sha256(payload) AS row_hash FROM rows WHERE n = 1
UNION ALL SELECT r.tenant_id, r.id, r.n, c.row_hash, sha256(concat(c.row_hash, r.payload)) FROM chain c JOIN rows r ON r.tenant_id = c.tenant_id AND r.n = c.n + 1)
SELECT tenant_id, id, prev_hash, row_hash FROM chain"""  # fmt: skip
