"""The event table's declared schema, its sentinels, enumerations and limits.

No column is null: 0 and '' stand for missing values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 1

#: Columns in order, with Spark type, sentinel, and whether few distinct values are expected ("low").
#: The table's contract.
COLUMNS: tuple[tuple[str, str, object, str], ...] = (
    ("ts", "timestamp", None, ""),
    ("duration_us", "long", 0, ""),
    ("db_name", "string", "<unknown>", "low"),
    ("db_user", "string", "<unknown>", "low"),
    ("pid", "int", 0, ""),
    ("query_id", "long", 0, ""),
    ("db_operation", "string", "UNKNOWN", "low"),
    ("rows", "long", 0, ""),
    ("query_text", "string", "", ""),
    *((f"{area}_blks_{what}", "long", 0, "") for area in ("shared", "local") for what in ("hit", "read", "dirtied", "written")),
    ("temp_blks_read", "long", 0, ""),
    ("temp_blks_written", "long", 0, ""),
    *((f"{area}_blk_{what}_time_us", "long", 0, "") for area in ("shared", "local", "temp") for what in ("read", "write")),
    ("wal_records", "long", 0, ""),
    ("wal_fpi", "long", 0, ""),
    ("wal_bytes", "long", 0, ""),
    ("cpu_user_time_us", "long", 0, ""),
    ("cpu_sys_time_us", "long", 0, ""),
    ("jit_functions", "int", 0, ""),
    *((f"jit_{phase}_time_us", "int", 0, "") for phase in ("generation", "deform", "inlining", "optimization", "emission")),
    ("parallel_workers_planned", "short", 0, ""),
    ("parallel_workers_launched", "short", 0, ""),
    ("err_sqlstate", "string", "", "low"),
    ("err_elevel", "short", 0, ""),
    ("err_message", "string", "", ""),
    ("app", "string", "", "low"),
    ("client_addr", "string", "", ""),
    ("instance_ubid", "string", "", ""),
    ("server_ubid", "string", "", ""),
    ("server_role", "string", "", "low"),
    ("read_replica_type", "string", "none", "low"),
    ("region", "string", "", "low"),
    ("cell", "string", "", "low"),
    ("service_version", "string", "", "low"),
    ("host_id", "string", "", ""),
    ("pod_name", "string", "", ""),
)

SPARK_TYPES = {"timestamp": T.TimestampType(), "long": T.LongType(), "int": T.IntegerType(), "short": T.ShortType(), "string": T.StringType()}

EVENTS = T.StructType([T.StructField(name, SPARK_TYPES[kind], False, {"cardinality": low} if low else {}) for name, kind, _, low in COLUMNS])
NAMES = tuple(name for name, *_ in COLUMNS)

#: What only the envelope of a batch knows; see functions.ingest.enrich.
ENVELOPE = NAMES[-9:]
#: Columns whose source values are unsigned 64-bit.
UNSIGNED = ("duration_us", "rows", "wal_bytes")
#: Columns of the error view.
ERROR_COLUMNS = ("ts", "instance_ubid", "db_name", "db_user", "app", "client_addr", "pid", "query_id", "err_sqlstate", "err_elevel", "err_message", "query_text")

COMMANDS = ("UNKNOWN", "SELECT", "UPDATE", "INSERT", "DELETE", "MERGE", "UTILITY", "NOTHING")
ERROR_LEVELS = {"debug5": 10, "debug4": 11, "debug3": 12, "debug2": 13, "debug1": 14, "log": 15, "info": 17, "notice": 18, "warning": 19, "error": 21, "fatal": 22, "panic": 23}
#: An issue has any level over 0; an error is at this level or above.
ERROR = ERROR_LEVELS["error"]
SQLSTATES = {
    "42P01": "undefined table",
    "42703": "undefined column",
    "23505": "unique violation",
    "23503": "foreign key violation",
    "42601": "syntax error",
    "57014": "query canceled",
    "40001": "serialization failure",
    "53100": "disk full",
    "53200": "out of memory",
}
#: Longest texts in bytes.
LIMITS = {"query_text": 2047, "err_message": 2047, "db_name": 63, "db_user": 63, "app": 63, "client_addr": 45}


def conform(df: DataFrame) -> DataFrame:
    """The declared columns in order and type, matched by name; nulls and absent columns become sentinels.

    A timestamp without zone is read as UTC in a UTC session.  ts has no sentinel: its rows must have one.
    """
    found = {c.lower(): c for c in df.columns}
    out = []
    for name, kind, sentinel, _ in COLUMNS:
        column = F.col(found[name]).cast(kind) if name in found else F.lit(None).cast(kind)
        out.append((F.coalesce(column, F.lit(sentinel).cast(kind)) if sentinel is not None else column).alias(name))
    return df.select(*out)


def split_overflow(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that fit, rows whose unsigned columns, read as decimals, exceed a signed long)."""
    over = F.lit(False)
    for c in UNSIGNED:
        over = over | (F.col(c).cast("decimal(20,0)") > F.lit(2**63 - 1).cast("decimal(20,0)"))
    over = F.coalesce(over, F.lit(False))
    return df.where(~over), df.where(over)
