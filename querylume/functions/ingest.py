"""Ingest transforms: what happens to an event between its source and the event table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

import querylume
from querylume.sources.schema import COMMANDS, ENVELOPE, ERROR_LEVELS, LIMITS

#: Microseconds from the Unix epoch to the servers' own, 2000-01-01.
SERVER_EPOCH_US = 946_684_800_000_000
#: Statements that are never events: they only wrap others, or bound transactions (fixed values).
SKIPPED_TAGS = ("EXECUTE", "PREPARE", "DEALLOCATE", "BEGIN", "START TRANSACTION", "COMMIT", "ROLLBACK", "SAVEPOINT", "RELEASE", "ROLLBACK TO", "PREPARE TRANSACTION", "COMMIT PREPARED", "ROLLBACK PREPARED")
#: Utility statements whose row count means something (fixed values).
COUNTING_TAGS = ("COPY", "FETCH", "SELECT", "REFRESH MATERIALIZED VIEW")


def statement_filter(df: DataFrame, tag: str = "tag", enabled: bool = True) -> DataFrame:
    """Without skipped statements and parallel workers' events; nothing if capture is off."""
    out = df.where(F.lit(enabled) & ~F.upper(F.coalesce(tag, F.lit(""))).isin(*SKIPPED_TAGS))
    return out.where(~F.coalesce("is_parallel_worker", F.lit(False))) if "is_parallel_worker" in df.columns else out


def level_filter(df: DataFrame, least: str = "warning") -> DataFrame:
    """Messages at the level or above; events that are no messages stay."""
    return df.where((F.col("err_elevel") == 0) | (F.col("err_elevel") >= ERROR_LEVELS[least]))


def sampled(df: DataFrame, min_duration_us: int = 0, rate: float = 1.0, key: str | list[str] = "event_id", weighted: bool = False) -> DataFrame:
    """Every event of `min_duration_us` or more, and `rate` of the faster ones; messages always stay.

    A least duration of 0 keeps everything, whatever the rate.  The draw is a hash of `key`, so a retried
    task draws the same; give all columns where no single one tells events apart.  `weighted` adds sample_weight, 1 / rate for drawn events, so that sums stay unbiased.
    """
    sure = (F.col("duration_us") >= min_duration_us) | (F.col("err_elevel") > 0)
    drawn = F.pmod(F.xxhash64(*([key] if isinstance(key, str) else key)), F.lit(1_000_000)) < int(max(0.0, min(1.0, rate)) * 1_000_000)
    out = df.where(sure | drawn)
    return out.withColumn("sample_weight", F.when(sure, F.lit(1.0)).otherwise(F.lit(1 / rate if rate > 0 else 0.0))) if weighted else out


def trimmed(text: str | Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def statement(text: Column, start: Column, length: Column) -> Column:
    """One statement of several, by byte offset and length (0: to the end), trimmed."""
    raw = F.encode(text, "UTF-8")
    rest = F.when(length > 0, length).otherwise(F.length(raw) - start)
    return trimmed(F.decode(F.substring(raw, start + 1, rest), "UTF-8"))


def with_texts(events: DataFrame, texts: DataFrame) -> DataFrame:
    """query_text looked up by query_id; a miss is ''.

    `texts` has one row a query_id.  Spark broadcasts it if statistics show that it is small, and otherwise
    shuffles both sides; a stream of events may be joined to a static table of texts the same way.
    """
    found = events.drop("query_text").join(texts.select("query_id", "query_text"), "query_id", "left")
    return found.withColumn("query_text", F.coalesce("query_text", F.lit("")))


def interned(events: DataFrame) -> DataFrame:
    """Each text once for its database and query id, with hash and length; the table with_texts() reads."""
    rows = events.where("query_text <> ''").select("db_name", "query_id", "query_text").distinct()
    return rows.withColumn("text_hash", F.xxhash64("query_text")).withColumn("text_bytes", F.octet_length("query_text"))


def sqlstate(code: Column) -> Column:
    """I8: five characters packed in six bits each, the first one lowest."""
    return F.concat(*[F.chr(F.shiftright(code, 6 * i).bitwiseAND(63) + 48) for i in range(5)])


def command(number: Column) -> Column:
    """Name of a command number; UNKNOWN for all that are none."""
    out = F.lit(COMMANDS[0])
    for i, name in enumerate(COMMANDS):
        out = F.when(number == i, F.lit(name)).otherwise(out)
    return out


def from_server_epoch(us: Column) -> Column:
    """I10."""
    return F.timestamp_micros(us + SERVER_EPOCH_US)


def clamped(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Negative counters become 0."""
    names = [c for c in (columns or df.columns) if c.endswith(("_us", "_read", "_hit", "_dirtied", "_written", "_records", "_fpi", "_bytes", "_functions"))]
    return df.withColumns({c: F.greatest(F.col(c), F.lit(0).cast(df.schema[c].dataType)) for c in names})


def cut_bytes(text: str | Column, n: int) -> Column:
    """At most n bytes of UTF-8, and never half a character: trailing bytes of a cut one are left out."""
    raw = F.substring(F.encode(text, "UTF-8"), 1, n)
    whole = F.regexp_replace(F.decode(raw, "ISO-8859-1"), "[À-ß]$|[à-ï][\u0080-¿]{0,1}$|[ð-÷][\u0080-¿]{0,2}$", "")
    cut = F.decode(F.encode(whole, "ISO-8859-1"), "UTF-8")
    return F.when(F.octet_length(text) <= n, text if isinstance(text, Column) else F.col(text)).otherwise(cut)  # most are short, and a cut is costly


def cut_texts(df: DataFrame) -> DataFrame:
    """I12 for every column with a limit."""
    return df.withColumns({c: cut_bytes(c, n) for c, n in LIMITS.items() if c in df.columns})


def attributes(text: str, strip: bool = False) -> dict[str, str]:
    """`k:v;k:v`; the first colon parts key and value, and the first of equal keys counts.

    `strip` trims spaces and leaves out empty keys, as older batches were read.
    """
    out: dict[str, str] = {}
    for part in text.split(";"):
        key, colon, value = part.partition(":")
        if strip:
            key, value = key.strip(" "), value.strip(" ")
        if colon and (key or not strip):
            out.setdefault(key, value)
    return out


def filled(df: DataFrame, known: dict[str, str]) -> DataFrame:
    """enrich() for rows that may already have an envelope: only what is absent, null or empty is filled."""
    values = {"read_replica_type": "none", "service_version": querylume.__version__} | {k: v for k, v in known.items() if v}
    own = {c: F.when(F.col(c).cast("string") != "", F.col(c).cast("string")) if c in df.columns else F.lit(None).cast("string") for c in ENVELOPE}
    return df.withColumns({c: F.coalesce(own[c], F.lit(values.get(c, ""))) for c in ENVELOPE})


def enrich(df: DataFrame, known: dict[str, str] | None = None, **more: str) -> DataFrame:
    """The nine envelope columns, the same for every row of a batch."""
    values = {"read_replica_type": "none", "service_version": querylume.__version__} | (known or {}) | more
    return df.withColumns({c: F.lit(values.get(c) or ("none" if c == "read_replica_type" else "")) for c in ENVELOPE})


def local_address(address: Column) -> Column:
    """I15."""
    return F.when(address == "[local]", F.lit("127.0.0.1")).otherwise(address)


def utility_rows(tag: Column, rows: Column) -> Column:
    """I16: row counts of utility statements that have one, else 0."""
    return F.when(F.upper(tag).isin(*COUNTING_TAGS), rows).otherwise(F.lit(0).cast("long"))


def deltas(df: DataFrame, columns: list[str], keys: list[str], order: list[str]) -> DataFrame:
    """Cumulative counters as the difference from the row before: 0 for the first row, the counter itself after a reset."""
    before = Window.partitionBy(*keys).orderBy(*order)
    last = {c: F.coalesce(F.lag(c).over(before), F.col(c)) for c in columns}
    return df.withColumns({c: F.when(F.col(c) >= last[c], F.col(c) - last[c]).otherwise(F.col(c)) for c in columns})
