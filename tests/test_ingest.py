import random
import re

import pytest
from pyspark.sql import functions as F

from querylume.config import NAMES, Config
from querylume.functions import ingest, normalize
from querylume.operators.recipes import signed_id
from querylume.sources import schema


def one(spark, column, **values):
    shape = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], shape).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("SELECT * FROM pg_class WHERE relname = 'x'", "SELECT * FROM pg_class WHERE relname = $1"),
        ("SELECT * FROM n WHERE id > 10 AND val = 'secret'", "SELECT * FROM n WHERE id > $1 AND val = $2"),
        ("SELECT * FROM n WHERE id = -99", "SELECT * FROM n WHERE id = $1"),
        ("SELECT a - 1 FROM t2", "SELECT a - $1 FROM t2"),
        ("SELECT 3.14, 1e5, .5", "SELECT $1, $2, $3"),
        ("SELECT count(*) FROM t1", "SELECT count(*) FROM t1"),
        ("SELECT 'it''s', \"a1\", $$x 'y'$$", "SELECT $1, \"a1\", $2"),
        ("SELECT $2, 5 /* 7 */ -- 8", "SELECT $2, $3 /* 7 */ -- 8"),
        ("INSERT INTO test_norm VALUES (100, 'data')", "INSERT INTO test_norm VALUES ($1, $2)"),
        ("SELECT E'a', x'1F' FROM s.t WHERE b BETWEEN 1 AND 2", "SELECT $1, $2 FROM s.t WHERE b BETWEEN $3 AND $4"),
        ("SELECT E'a\\'secret', E'b\\\\', 'c\\'", "SELECT $1, $2, $3"),
        ("SELECT 0x1F, 0o17, 0b1_01, 1_000, 1_0.5_0e1_0", "SELECT $1, $2, $3, $4, $5"),
        ("SELECT /* a /* 9 */ '8' */ 7", "SELECT /* a /* 9 */ '8' */ $1"),
        ("SELECT U&'d\\0061t', u&\"a1\" FROM t", "SELECT $1, u&\"a1\" FROM t"),
        ("SELECT $tag1$ 'x' $$ 1 $tag1$, $1", "SELECT $2, $1"),
        ("SELECT * FROM t WHERE s = 'cut in the mid", "SELECT * FROM t WHERE s = $1"),
        ("SELECT $a$ cut", "SELECT $1"),
        ("SELECT 1 AS \u00e92, t3.c4", "SELECT $1 AS \u00e92, t3.c4"),
        ("", ""),
    ],
)
def test_normalize(spark, text, expected):
    assert one(spark, normalize.normalize(F.col("t")), t=text) == expected


def test_no_generated_literal_is_left(spark):
    """Whatever stands between quotes, or is a number, goes; names, parameters and comments stay."""
    rng, rows = random.Random(2), []
    kinds = (lambda: f"'s{rng.randrange(10**6)}ecret''s'", lambda: f"E's\\'{rng.randrange(10**6)}ecret\\\\'", lambda: f"$t$secret '{rng.randrange(99)}$t$", lambda: str(rng.randrange(10**9)), lambda: f"{rng.random():.5f}e-7", lambda: hex(rng.randrange(10**9)), lambda: "B'1010'")
    for i in range(300):
        made = [rng.choice(kinds)() for _ in range(rng.randrange(1, 8))]
        rows.append((i, "SELECT " + rng.choice([", ", " + ", " /* n7 */ , "]).join(f"c{j} = {x}" for j, x in enumerate(made)) + " -- end 5", len(made)))
    for r in normalize.normalized(spark.createDataFrame(rows, "id int, query_text string, n int")).collect():
        bare = re.sub(r"c\d|n7|end 5", "", r["query_text"])
        assert "ecret" not in bare and re.findall(r"\$?[\da-fA-Fx]*\d", bare) == [f"${i + 1}" for i in range(r["n"])]


def test_deltas_after_a_reset(spark):
    rows = spark.createDataFrame([(1, 1, 10), (1, 2, 25), (1, 3, 4), (1, 4, 9), (2, 1, 7)], "pid int, at int, wal_bytes long")
    assert [r["wal_bytes"] for r in ingest.deltas(rows, ["wal_bytes"], ["pid"], ["at"]).orderBy("pid", "at").collect()] == [0, 15, 4, 5, 0]


def test_sampling_draws_rows_of_one_instant_apart(spark):
    rows = spark.range(1000).selectExpr("id AS query_id", "TIMESTAMP '2024-01-01' AS ts", "1L AS duration_us", "CAST(0 AS SMALLINT) AS err_elevel")
    assert 400 < ingest.sampled(rows, 100, 0.5, key=rows.columns).count() < 600


def test_normalize_squashes_lists(spark):
    assert one(spark, normalize.normalize(F.col("t"), squash=True), t="SELECT 1 WHERE a IN (1, 2,3)").startswith("SELECT $1 WHERE a IN (")


def test_cut_bytes_keeps_whole_characters(spark):
    assert one(spark, ingest.cut_bytes("t", 4), t="aéé") == "aé"
    assert one(spark, ingest.cut_bytes("t", 5), t="aéé") == "aéé"
    assert one(spark, ingest.cut_bytes("t", 3), t="a😀") == "a"
    assert one(spark, ingest.cut_bytes("t", 10), t="") == ""


def test_statement_slice(spark):
    assert one(spark, ingest.statement(F.col("t"), F.lit(10), F.lit(0)), t="SELECT 1;  SELECT 2 \n") == "SELECT 2"


def test_attributes_first_key_wins():
    text = "instance_ubid:test-instance;server_role:primary;region:a:b;region:c; cell : x ;:empty;none"
    assert ingest.attributes(text) == {"instance_ubid": "test-instance", "server_role": "primary", "region": "a:b", " cell ": " x ", "": "empty"}
    assert ingest.attributes(text, strip=True)["cell"] == "x"
    assert "" not in ingest.attributes(text, strip=True)


def test_sampling_keeps_threshold_and_messages(spark):
    rows = spark.range(2000).selectExpr("id AS event_id", "id AS duration_us", "CAST(IF(id < 10, 21, 0) AS SMALLINT) AS err_elevel")
    none = ingest.sampled(rows, 1000, 0.0)
    assert none.count() == 1010
    some = ingest.sampled(rows, 1000, 0.25, weighted=True)
    assert 1010 < some.count() < 1500
    assert 1600 < some.agg(F.sum("sample_weight")).first()[0] < 2400
    assert ingest.sampled(rows, 0, 0.0).count() == 2000


def test_conform_fills_sentinels(spark):
    row = schema.conform(spark.createDataFrame([(1, None)], "PID int, db_name string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))).first()
    assert (row["pid"], row["db_name"], row["read_replica_type"], row["err_elevel"]) == (1, "<unknown>", "none", 0)
    assert len(row) == 52


def test_overflow_is_set_apart(spark):
    rows = spark.sql("SELECT CAST(18446744073709551615 AS DECIMAL(20,0)) AS duration_us, CAST(1 AS DECIMAL(20,0)) AS rows, CAST(1 AS DECIMAL(20,0)) AS wal_bytes UNION ALL SELECT 5, 6, 7")
    fits, over = schema.split_overflow(rows)
    assert (fits.count(), over.count()) == (1, 1)


def test_query_ids_in_both_spellings():
    assert signed_id("14460383662181259114") == -3986360411528292502 == signed_id(-3986360411528292502)
    with pytest.raises(ValueError):
        signed_id(2**64)


def test_config():
    assert len(NAMES) == 30
    assert Config().queue_capacity == 131072
    assert Config().with_values(enabled="off", batch_max="10").batch_max == 10
    for bad in ({"queue_capacity": 3000}, {"batch_max": 0}, {"log_min_elevel": "loud"}, {"sample_rate": 1.5}):
        with pytest.raises(ValueError):
            Config().with_values(**bad)
    config, refused = Config().lenient(queue_capacity=4096, flush_interval_ms=1)
    assert config.queue_capacity == 4096 and config.flush_interval_ms == 500 and list(refused) == ["flush_interval_ms"]
    assert Config(use_otel=True, otel_arrow_passthrough=True, use_unified_arrow_exporter=True).sink == "unified_arrow"
