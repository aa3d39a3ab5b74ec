"""The driver's `events` table seen as telemetry: one SQL text that Spark and DuckDB both run.

Besides the event columns it keeps event_id, a tie-break for orders that the recipes leave open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FROM_EVENTS = """
SELECT
  event_id, ts,
  CASE WHEN event_type = 'error' THEN CAST(0 AS BIGINT) ELSE CAST(round(value * 1000) AS BIGINT) END AS duration_us,
  'db_' || CAST(user_id % 4 AS VARCHAR(20)) AS db_name,
  'user_' || CAST(user_id % 10 AS VARCHAR(20)) AS db_user,
  CAST(1000 + user_id AS INT) AS pid,
  CASE WHEN event_type = 'error' THEN CAST(0 AS BIGINT) ELSE user_id % 50 + 1 END AS query_id,
  CASE event_type WHEN 'view' THEN 'SELECT' WHEN 'click' THEN 'INSERT' WHEN 'purchase' THEN 'UPDATE' WHEN 'signup' THEN 'UTILITY' ELSE 'UNKNOWN' END AS db_operation,
  CASE WHEN event_type = 'error' THEN CAST(0 AS BIGINT) ELSE event_id % 100 END AS rows,
  CASE WHEN event_type = 'error' THEN '' ELSE 'SELECT * FROM t WHERE k = ' || props END AS query_text,
  (event_id * 7) % 1000 AS shared_blks_hit, (event_id * 13) % 250 AS shared_blks_read,
  (event_id * 3) % 40 AS shared_blks_dirtied, event_id % 5 AS shared_blks_written,
  (event_id * 11) % 60 AS local_blks_hit, event_id % 9 AS local_blks_read, event_id % 7 AS local_blks_dirtied, event_id % 3 AS local_blks_written,
  CASE WHEN event_id % 8 = 0 THEN (event_id * 5) % 300 ELSE CAST(0 AS BIGINT) END AS temp_blks_read,
  CASE WHEN event_id % 8 = 0 THEN (event_id * 17) % 500 + 1 ELSE CAST(0 AS BIGINT) END AS temp_blks_written,
  (event_id * 19) % 5000 AS shared_blk_read_time_us, (event_id * 23) % 900 AS shared_blk_write_time_us,
  CASE WHEN event_id % 6 = 0 THEN (event_id * 29) % 700 ELSE CAST(0 AS BIGINT) END AS local_blk_read_time_us,
  CASE WHEN event_id % 10 = 0 THEN (event_id * 31) % 400 ELSE CAST(0 AS BIGINT) END AS local_blk_write_time_us,
  event_id % 50 AS temp_blk_read_time_us, event_id % 70 AS temp_blk_write_time_us,
  event_id % 20 AS wal_records, event_id % 4 AS wal_fpi, (event_id * 97) % 8192 AS wal_bytes,
  CAST(round(value * 600) AS BIGINT) AS cpu_user_time_us, CAST(round(value * 50) AS BIGINT) AS cpu_sys_time_us,
  CAST(CASE WHEN event_id % 5 = 0 THEN event_id % 12 + 1 ELSE 0 END AS INT) AS jit_functions,
  CAST(CASE WHEN event_id % 5 = 0 THEN (event_id * 37) % 9000 ELSE 0 END AS INT) AS jit_generation_time_us,
  CAST(CASE WHEN event_id % 5 = 0 THEN (event_id * 41) % 3000 ELSE 0 END AS INT) AS jit_deform_time_us,
  CAST(CASE WHEN event_id % 5 = 0 THEN (event_id * 43) % 8000 ELSE 0 END AS INT) AS jit_inlining_time_us,
  CAST(CASE WHEN event_id % 5 = 0 THEN (event_id * 47) % 20000 ELSE 0 END AS INT) AS jit_optimization_time_us,
  CAST(CASE WHEN event_id % 5 = 0 THEN (event_id * 53) % 15000 ELSE 0 END AS INT) AS jit_emission_time_us,
  CAST(event_id % 4 AS SMALLINT) AS parallel_workers_planned, CAST(event_id % 3 AS SMALLINT) AS parallel_workers_launched,
  CASE WHEN event_type <> 'error' THEN '' WHEN event_id % 3 = 0 THEN '23505' WHEN event_id % 3 = 1 THEN '42P01' ELSE '57014' END AS err_sqlstate,
  CAST(CASE WHEN event_type <> 'error' THEN 0 WHEN event_id % 5 = 0 THEN 19 ELSE 21 END AS SMALLINT) AS err_elevel,
  CASE WHEN event_type <> 'error' THEN '' ELSE 'message ' || CAST(event_id % 17 AS VARCHAR(20)) END AS err_message,
  'app_' || CAST(user_id % 6 AS VARCHAR(20)) AS app,
  '10.0.0.' || CAST(user_id % 200 AS VARCHAR(20)) AS client_addr,
  'inst_' || CAST(user_id % 3 AS VARCHAR(20)) AS instance_ubid,
  'srv_' || CAST(user_id % 5 AS VARCHAR(20)) AS server_ubid,
  CASE WHEN user_id % 5 = 0 THEN 'standby' ELSE 'primary' END AS server_role,
  CASE WHEN user_id % 15 = 0 THEN 'regional' ELSE 'none' END AS read_replica_type,
  'region_' || CAST(user_id % 2 AS VARCHAR(20)) AS region,
  'cell_' || CAST(user_id % 8 AS VARCHAR(20)) AS cell,
  '0.1' AS service_version,
  'host_' || CAST(user_id % 5 AS VARCHAR(20)) AS host_id,
  '' AS pod_name
FROM {events}
"""


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adapter over a folder's events table; Catalyst prunes what a query does not read."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(FROM_EVENTS, events=events)
