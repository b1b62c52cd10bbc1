"""Registered queries of the keyed streams: their batch twins over the driver's events and texts, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..streaming import events as E
from ..streaming import persist as P
from ..streaming import state as S
from .checks import duck, view
from .registry import registered, table

MS = "epoch_us(ts) // 1000"


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("at_ms", F.unix_millis(F.col("ts").cast("timestamp")))


# files that settle, go and come back
SCANS = """SELECT '/in/' || CAST(user_id % 40 AS STRING) AS path, CAST(floor(event_id / 20) AS BIGINT) AS scan, CAST(max(event_id % 2) AS BIGINT) AS size, CAST(0 AS BIGINT) AS mtime, min(event_id) AS now
 FROM {events} GROUP BY user_id % 40, floor(event_id / 20)"""
EVICTED = f"""WITH RECURSIVE t AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY now) AS k FROM ({duck(SCANS)})),
s AS (SELECT DISTINCT path, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS scan, CAST(0 AS BIGINT) AS size, CAST(0 AS BIGINT) AS polls, CAST(NULL AS BIGINT) AS sent_size, false AS sent FROM t
 UNION ALL SELECT path, tk, tscan, tsize, n, CASE WHEN go THEN tsize ELSE kept END, go FROM (SELECT *, n >= 2 AND now >= 5 AND kept IS DISTINCT FROM tsize AS go FROM (
  SELECT path, tk, tscan, tsize, now, CASE WHEN NOT away THEN sent_size END AS kept, CASE WHEN tsize > CASE WHEN away THEN 0 ELSE size END THEN 0 WHEN tsize = CASE WHEN away THEN 0 ELSE size END THEN CASE WHEN away THEN 0 ELSE polls END + 1 ELSE 1 END AS n
  FROM (SELECT s.*, t.k AS tk, t.scan AS tscan, t.size AS tsize, t.now, coalesce(t.scan > s.scan + 1, false) AS away FROM s JOIN t ON t.path = s.path AND t.k = s.k + 1))))
SELECT path, size, CAST(0 AS BIGINT) AS mtime, polls FROM s WHERE sent"""
registered("t03_settled_and_gone", EVICTED)(lambda spark, sf: S.settled_batch(view(spark, sf, SCANS)))

# job phases; what may follow what, as text
FOLLOWS = """VALUES ('queued', 'probing'), ('queued', 'cancel_requested'), ('queued', 'cancelled'), ('queued', 'failed'), ('probing', 'planned'), ('probing', 'normalizing_audio'), ('probing', 'failed'), ('probing', 'cancel_requested'), ('probing', 'cancelled'),
 ('normalizing_audio', 'planned'), ('normalizing_audio', 'encoding'), ('normalizing_audio', 'failed'), ('normalizing_audio', 'cancel_requested'), ('normalizing_audio', 'cancelled'), ('planned', 'encoding'), ('planned', 'failed'), ('planned', 'cancel_requested'), ('planned', 'cancelled'),
 ('encoding', 'validating'), ('encoding', 'failed'), ('encoding', 'recoverable'), ('encoding', 'cancel_requested'), ('encoding', 'cancelled'), ('validating', 'publishing'), ('validating', 'failed'), ('validating', 'recoverable'), ('validating', 'cancel_requested'), ('validating', 'cancelled'),
 ('publishing', 'completed'), ('publishing', 'failed'), ('recoverable', 'encoding'), ('recoverable', 'probing'), ('recoverable', 'failed'), ('recoverable', 'cancel_requested'), ('recoverable', 'cancelled'), ('cancel_requested', 'cancelled'), ('cancel_requested', 'failed'), ('failed', 'queued')"""
PHASED = """SELECT CAST(user_id AS STRING) AS id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'probing' WHEN 'view' THEN 'planned' WHEN 'click' THEN 'encoding' WHEN 'purchase' THEN 'validating' WHEN 'error' THEN 'failed' ELSE 'queued' END AS phase FROM {events}"""

JOB_FOLD = f"""WITH RECURSIVE f(a, b) AS ({FOLLOWS}), t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS k, COUNT(*) OVER (PARTITION BY id) AS n FROM ({duck(PHASED)})),
s AS (SELECT DISTINCT id, CAST(0 AS BIGINT) AS k, n, 'queued' AS phase, CAST(0 AS BIGINT) AS applied, CAST(0 AS BIGINT) AS rejected, CAST(NULL AS BIGINT) AS started, CAST(NULL AS BIGINT) AS finished FROM t
 UNION ALL SELECT id, tk, n, CASE WHEN ok THEN tphase ELSE phase END, applied + CASE WHEN ok THEN 1 ELSE 0 END, rejected + CASE WHEN ok THEN 0 ELSE 1 END,
  CASE WHEN ok AND started IS NULL AND tphase <> 'queued' THEN seq ELSE started END, CASE WHEN ok AND tphase IN ('completed', 'failed', 'cancelled') THEN seq ELSE finished END
 FROM (SELECT s.*, t.k AS tk, t.phase AS tphase, t.seq, t.phase = s.phase OR EXISTS (SELECT 1 FROM f WHERE f.a = s.phase AND f.b = t.phase) AS ok FROM s JOIN t ON t.id = s.id AND t.k = s.k + 1))
SELECT id, phase, applied, rejected, started, finished FROM s WHERE k = n"""
registered("t09_job_phases", JOB_FOLD)(lambda spark, sf: S.job_phases(view(spark, sf, PHASED)))
NAMES = ("queued", "probing", "normalizing_audio", "planned", "encoding", "validating", "publishing", "recoverable", "cancel_requested", "failed", "completed", "cancelled")
MAY_FOLLOW = f"SELECT event_id, x AS before_phase, y AS after_phase, x = y OR EXISTS (SELECT 1 FROM ({FOLLOWS}) f(a, b) WHERE f.a = x AND f.b = y) AS allowed FROM (SELECT event_id, {list(NAMES)}[event_id % 12 + 1] AS x, {list(NAMES)}[event_id // 12 % 12 + 1] AS y FROM events)"


@registered("x25_may_follow", MAY_FOLLOW)
def may_follow(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of phases, one for each event."""
    pick = lambda k: F.element_at(F.array(*map(F.lit, NAMES)), (k % 12 + 1).cast("int"))
    pairs = table(spark, sf, "events").select("event_id", pick(F.col("event_id")).alias("before_phase"), pick(F.floor(F.col("event_id") / 12)).alias("after_phase"))
    return pairs.withColumn("allowed", R.may_follow(F.col("before_phase"), F.col("after_phase")))


registered("s21_phases", f"SELECT event_id, phase, CASE WHEN phase = 'queued' THEN 'Pending' WHEN phase = 'completed' THEN 'Completed' WHEN phase = 'failed' THEN 'Failed' WHEN phase = 'cancelled' THEN 'Cancelled' ELSE 'Processing' END AS state FROM (SELECT event_id, {list(NAMES)}[event_id % 12 + 1] AS phase FROM events)")(
    lambda spark, sf: table(spark, sf, "events").select("event_id", F.element_at(F.array(*map(F.lit, NAMES)), (F.col("event_id") % 12 + 1).cast("int")).alias("phase")).withColumn("state", R.state_of(F.col("phase")))
)


# leases
BEATS = f"SELECT 'j' || CAST(user_id AS VARCHAR) AS id, {MS} AS at_ms, 'w' || CAST(event_id % 3 AS VARCHAR) AS worker, event_type = 'purchase' AS ended FROM events"
LEASE, UNTIL = 21_600_000, 1_706_745_600_000
registered("t07_expired_leases", f"SELECT id, worker, at_ms + {LEASE} AS expired_at FROM (SELECT *, coalesce(lead(at_ms) OVER (PARTITION BY id ORDER BY at_ms, worker, ended), {UNTIL}) AS next FROM ({BEATS})) WHERE NOT ended AND next > at_ms + {LEASE}")(
    lambda spark, sf: S.expired_leases(events(spark, sf).select(F.concat(F.lit("j"), "user_id").alias("id"), "at_ms", F.concat(F.lit("w"), F.col("event_id") % 3).alias("worker"), (F.col("event_type") == "purchase").alias("ended")), LEASE, UNTIL)
)

# two channels
WITHIN = 43_200_000
CHANNELS = f"""WITH RECURSIVE t AS (SELECT CAST(user_id AS VARCHAR) AS path, {MS} AS at_ms, CASE WHEN event_id % 3 = 0 THEN 'retry' ELSE 'watch' END AS channel, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT path, at_ms, channel, k, at_ms AS taken, true AS kept FROM t WHERE k = 1
 UNION ALL SELECT t.path, t.at_ms, t.channel, t.k, CASE WHEN t.at_ms - r.taken > {WITHIN} THEN t.at_ms ELSE r.taken END, t.at_ms - r.taken > {WITHIN} FROM r JOIN t ON t.path = r.path AND t.k = r.k + 1)
SELECT path, at_ms, channel FROM r WHERE kept"""


@registered("u04_channels", CHANNELS)
def channels(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).select(F.col("user_id").cast("string").alias("path"), "at_ms", "event_id")
    return S.merged_channels(e.where("event_id % 3 <> 0"), e.where("event_id % 3 = 0"), WITHIN)


# persisted changes, some of which come again
@registered("m32_persisted", "SELECT id, seq, state, created_at FROM (SELECT 'j' || CAST(user_id AS VARCHAR) AS id, event_id AS seq, event_type AS state, min_by(ts, event_id) OVER (PARTITION BY user_id) AS created_at, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def persisted(spark: SparkSession, sf: str) -> DataFrame:
    changes = events(spark, sf).select(F.concat(F.lit("j"), "user_id").alias("id"), F.col("event_id").alias("seq"), F.col("event_type").alias("state"), F.col("ts").alias("created_at"))
    return P.merged(changes.unionByName(changes.where("seq % 7 = 0")))


# envelopes, routed
ENVELOPE = """CASE event_id % 8 WHEN 0 THEN '{"event":"job_update","data":{"id":"j' || CAST(user_id AS STRING) || '","stage":"Probing","phase":"probing"}}'
 WHEN 1 THEN '{"event":"progress","data":{"id":"j' || CAST(user_id AS STRING) || '","percent":' || CAST(event_id % 101 AS STRING) || '.5,"stage":"Encoding","current_time_ms":' || CAST(event_id AS STRING) || ',"determinate":true,"fps":25,"speed":"1x"}}'
 WHEN 2 THEN '{"event":"completed","data":{"id":"j' || CAST(user_id AS STRING) || '","uuid":"u' || CAST(event_id AS STRING) || '"}}' WHEN 3 THEN '{"event":"failed","data":{"id":"j' || CAST(user_id AS STRING) || '","error":"' || event_type || '"}}'
 WHEN 4 THEN 'no json ' || CAST(event_id AS STRING) WHEN 5 THEN '{"event":"paused","data":{}}' WHEN 6 THEN '{"data":[1]}' ELSE '{"event":"failed","data":{"id":"j"}}' END"""
J = "'j' || CAST(user_id AS VARCHAR) AS id"
ROUTED = {
    "job_update": f"SELECT event_id, {J}, 'Probing' AS stage, 'probing' AS phase FROM events WHERE event_id % 8 = 0",
    "progress": f"SELECT event_id, {J}, event_id % 101 + 0.5::DOUBLE AS percent, 'Encoding' AS stage, event_id AS current_time_ms, NULL::BIGINT AS duration_ms, true AS determinate, 25::DOUBLE AS fps, NULL::VARCHAR AS bitrate, '1x' AS speed FROM events WHERE event_id % 8 = 1",
    "completed": f"SELECT event_id, {J}, 'u' || CAST(event_id AS VARCHAR) AS uuid FROM events WHERE event_id % 8 = 2",
    "failed": f"SELECT event_id, {J}, event_type AS error FROM events WHERE event_id % 8 = 3",
    E.DEAD: f"SELECT event_id, value, CASE event_id % 8 WHEN 5 THEN 'paused' WHEN 7 THEN 'failed' END AS event, CASE event_id % 8 WHEN 4 THEN 'not_json' WHEN 5 THEN 'unknown_event' WHEN 6 THEN 'no_event' ELSE 'error_missing' END AS problem FROM (SELECT event_id, {ENVELOPE} AS value FROM events) WHERE event_id % 8 > 3",
}
for kind, sql in ROUTED.items():
    registered(f"t06_{kind}", sql)(lambda spark, sf, kind=kind: E.routed(E.parsed(table(spark, sf, "events").select("event_id", F.expr(ENVELOPE).alias("value"))), kind, ("event_id",)))


@registered("t05_fan_out", "SELECT event_id AS seq, place, CASE WHEN place = 0 THEN 'job_update' WHEN event_type = 'purchase' THEN 'completed' ELSE 'failed' END AS event, 'j' || CAST(user_id AS VARCHAR) AS id, CASE WHEN place = 1 AND event_type = 'purchase' AND user_id % 2 = 0 THEN 'u' || CAST(user_id AS VARCHAR) END AS uuid, CASE WHEN place = 1 AND event_type = 'error' THEN 'e \"' || CAST(event_id AS VARCHAR) || '\"' END AS error FROM events, (SELECT unnest([0, 1]) AS place) WHERE place = 0 OR event_type IN ('purchase', 'error')")
def fan_out(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    of = F.concat(F.lit("j"), "user_id").alias("id")
    phase = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("encoding")
    changes = e.select(of, F.col("event_id").alias("seq"), phase.alias("phase"), F.lit("s").alias("stage"), F.when(F.col("event_type") == "error", F.concat(F.lit('e "'), "event_id", F.lit('"'))).alias("error"))
    jobs = e.select(of, F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("u"), "user_id")).alias("uuid")).distinct()
    sent = E.parsed(E.fanned_out(jobs, changes))
    field = lambda name: F.try_variant_get("data", f"$.{name}", "string").alias(name)
    return sent.select("seq", "place", "event", field("id"), field("uuid"), field("error"))


# last lines
@registered("s19_last_lines", "SELECT key, list(line ORDER BY seq) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS k FROM (SELECT doc_id AS key, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS seq FROM documents) WHERE line <> '') WHERE k <= 5 GROUP BY key")
def stderr_tails(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.posexplode(F.split("text", "\n", -1)).alias("seq", "line"))
    return S.last_lines(S.log_text(lines), 5)


@registered("s25_log", "SELECT key, list(line ORDER BY seq) AS lines FROM (SELECT user_id AS key, event_id AS seq, strftime(ts, '%H:%M:%S') || ' [' || upper(event_type) || '] event ' || CAST(event_id AS VARCHAR) AS line FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 50) GROUP BY key")
def log(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), "ts", "event_type", F.concat(F.lit("event "), "event_id").alias("message"))
    return S.last_lines(e.withColumn("line", S.log_line("ts", "event_type", "message")), 50)
