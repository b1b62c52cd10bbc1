"""The media relations that the queries run on, derived from the driver's tables by SQL that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MEDIA_ASSETS = """
SELECT 'a' || lpad(CAST(o_orderkey AS STRING), 12, '0') AS uuid, o_custkey AS fingerprint,
 '/target/videos/c' || CAST(o_custkey AS STRING) || '.mp4' AS current_path,
 CAST(round(o_totalprice) AS BIGINT) AS duration_ms,
 CAST(CASE WHEN o_orderkey % 4 = 0 THEN 1000 ELSE 0 END AS BIGINT) AS trim_in_ms,
 CAST(CASE WHEN o_orderkey % 5 = 0 THEN floor(o_totalprice / 2) ELSE round(o_totalprice) END AS BIGINT) AS trim_out_ms,
 CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'K' WHEN '2' THEN '8' WHEN '3' THEN '12' WHEN '4' THEN '16' ELSE '18' END AS rating,
 CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'processing' ELSE 'error' END AS status,
 CASE WHEN o_orderkey % 11 = 0 THEN 'Subclip ' ELSE 'Clip ' END || CAST(o_orderkey AS STRING) AS display_name,
 '/' || substr(o_orderpriority, 3) || '/' || CAST(year(o_orderdate) AS STRING) AS virtual_folder,
 CASE WHEN o_custkey % 7 = 0 OR o_orderkey % 13 = 0 THEN '/' || substr(o_orderpriority, 3) || '/' || CAST(year(o_orderdate) AS STRING) END AS original_virtual_folder,
 o_orderkey % 3 <> 0 AS mezzanine_ok,
 CAST(CASE WHEN o_orderkey % 2 = 0 THEN 25 ELSE 30000 END AS BIGINT) AS fps_num,
 CAST(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 1001 END AS BIGINT) AS fps_den,
 CASE WHEN o_custkey % 7 = 0 OR o_orderkey % 13 = 0 THEN o_orderdate END AS deleted_at
FROM orders"""

TRANSCODE_JOBS = """
SELECT 'j' || lpad(CAST(event_id AS STRING), 12, '0') AS id, 'a' || lpad(CAST(event_id AS STRING), 12, '0') AS uuid,
 user_id AS fingerprint, '/watch/in/u' || CAST(user_id AS STRING) || '.mov' AS input_path,
 CASE event_type WHEN 'signup' THEN 'Pending' WHEN 'view' THEN 'Processing' WHEN 'purchase' THEN 'Completed' WHEN 'error' THEN 'Failed' ELSE 'Cancelled' END AS state,
 CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'encoding' ELSE 'probing' END WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'cancelled' END AS phase,
 CASE WHEN event_type = 'error' THEN CASE event_id % 4 WHEN 0 THEN 'Probe: no such file or directory' WHEN 1 THEN 'ffmpeg exited with code 1' WHEN 2 THEN 'file locked (os error 32)' ELSE 'Job cancelled by user' END END AS error,
 CASE WHEN event_type = 'purchase' THEN '/target/videos/o' || CAST(event_id AS STRING) || '.mp4' END AS output_path,
 CASE WHEN event_type = 'view' THEN 'encoding' END AS current_stage, CAST(NULL AS STRING) AS error_category,
 CASE WHEN event_type = 'view' THEN 'w' || CAST(event_id % 3 AS STRING) END AS worker_id, event_type = 'view' AND event_id % 7 = 0 AS cancel_requested,
 CASE WHEN event_type = 'view' AND event_id % 4 <> 0 THEN ts + INTERVAL 10 SECONDS END AS leased_until,
 CASE WHEN event_type = 'view' THEN ts END AS heartbeat_at, CASE WHEN event_type = 'view' THEN ts END AS started_at,
 CASE WHEN event_type NOT IN ('signup', 'view') AND event_id % 5 <> 0 THEN ts + INTERVAL 60 SECONDS END AS finished_at,
 ts AS created_at, CAST(event_id % 3 + 1 AS BIGINT) AS attempt, CAST(2 AS BIGINT) AS max_attempts, value AS duration_secs
FROM events"""

FOLDER_COLORS = """
SELECT DISTINCT '/' || substr(o_orderpriority, 3) || '/' || CAST(year(o_orderdate) AS STRING) AS virtual_folder,
 CASE WHEN year(o_orderdate) % 2 = 0 THEN '#204060' ELSE '#a06020' END AS color
FROM orders WHERE substr(o_orderpriority, 1, 1) IN ('1', '2')
UNION ALL SELECT '/Archive', '#808080' UNION ALL SELECT '/Archive/Old', '#404040'"""

RELATIONS = {"media_assets": MEDIA_ASSETS, "transcode_jobs": TRANSCODE_JOBS, "virtual_folder_colors": FOLDER_COLORS}
SOURCES = {"media_assets": "orders", "transcode_jobs": "events", "virtual_folder_colors": "orders"}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived relation; columns that a query does not use are pruned from the scan below."""
    source = SOURCES[name]
    return spark.sql(RELATIONS[name].replace(f"FROM {source}", "FROM {source}"), source=spark.read.parquet(f"{sf_dir}/{source}.parquet"))


def oracle(sql: str) -> str:
    """A statement for DuckDB with the relations that it names in front."""
    used = [f"{name} AS ({text})" for name, text in RELATIONS.items() if name in sql]
    if not used:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join(used) + ", " + body[15:]
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(used) + ", " + body[5:]
    return "WITH " + ", ".join(used) + " " + body
