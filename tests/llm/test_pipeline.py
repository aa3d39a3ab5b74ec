import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline
from querylume.llm import decontaminate, near_dup, secrets
from querylume.llm.common import DOCUMENT_COLUMNS

ROOT = Path(__file__).resolve().parents[2]


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    rows, steps = docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, rows, small).write.parquet(f"file://{tmp_path}/{k}")
        rows = spark.read.parquet(f"file://{tmp_path}/{k}")
        steps.append(rows)
    good, single, clean, masked, packed = steps
    assert all(tuple(x.columns) == DOCUMENT_COLUMNS for x in steps[:4])
    assert good.exceptAll(docs).isEmpty() and 0 < good.count() < docs.count()
    assert single.exceptAll(good).isEmpty()
    found = near_dup.near_duplicates(single)
    assert found.select("root").distinct().count() == single.count()
    assert near_dup.near_duplicates(good).select("root").distinct().count() == single.count()
    assert decontaminate.report(single, items).where("contaminated").count() > 0
    assert decontaminate.report(clean, items).where("contaminated").count() == 0
    untouched = decontaminate.report(single, items).where("not contaminated").select("doc_id")
    assert single.join(untouched, "doc_id").select("doc_id", "text").exceptAll(clean.select("doc_id", "text")).isEmpty()
    assert secrets.scan(masked).where("base_sha256 <> sha2('', 256)").count() == 0
    assert masked.count() == clean.count() and masked.where("n_chars <> char_length(text)").count() == 0
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in masked.select("doc_id").collect()}


def test_run_over_odd_rows(spark, small, tmp_path):
    """Nulls, empty, repeated and very long texts, and an extra column with the name of an operator's own."""
    for name in ("documents", "labels", "benchmark"):
        rows = spark.read.parquet(f"{small}/{name}.parquet")
        if name == "documents":
            odd = [(None, "null id, with words of its own", "en", "s", 1), (90001, None, None, None, None), (90002, "", "en", "s", 0), (90003, "some words again and again " * 40_000, "en", "s", 5)]
            extra = spark.createDataFrame(odd, rows.select(*DOCUMENT_COLUMNS).schema)
            rows = rows.unionByName(extra, allowMissingColumns=True).unionByName(rows.limit(20)).withColumn("score", F.lit("mine")).withColumn("row", F.lit(1))
        rows.write.parquet(f"file://{tmp_path}/in/{name}.parquet")
    packed = corpus_pipeline.run(spark, f"file://{tmp_path}/in")
    assert packed.count() > 0 and packed.where("length <= 0 or length > 2048").isEmpty()
    docs = spark.read.parquet(f"file://{tmp_path}/in/documents.parquet")
    whole = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all"), F.countDistinct("doc_tokens").alias("k"))
    assert whole.where("n <> all or k <> 1").isEmpty()  # repeated rows have gone, and nothing is cut short
    assert packed.select("doc_id").exceptAll(packed.select("doc_id")).isEmpty() and packed.join(docs, "doc_id", "left_anti").where("doc_id is not null").isEmpty()


def test_run_over_empty_tables(spark, small, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{small}/{name}.parquet").limit(0).write.parquet(f"file://{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/none").count() == 0


def test_the_rest_stands_alone(tmp_path):
    """Without llm folders and pipeline, the entry point still imports and has the other queries."""
    for x in ("querylume", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / x), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "querylume" / "llm")], check=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') or k == 'pipeline' for k in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 60 and out[1] == "False"
