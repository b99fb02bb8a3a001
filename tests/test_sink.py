"""The document sink: attempts that don't count, failures, interrupted publications."""

import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tonguemill.sources import sink


def names(at):
    return sorted(str(p.relative_to(at)) for p in Path(at).rglob("*") if p.is_file())


def test_writes_and_replaces(spark, tmp_path):
    at = str(tmp_path / "ut med mellomrom")
    df = spark.createDataFrame([(f"{at}/a.txt", b"hei"), (f"{at}/sub/_b.txt", b""), (f"{at}/sub/å.txt", None)], "dest string, content binary").repartition(2)
    assert sorted((r.dest[len(at) + 1 :], r.bytes) for r in sink.write_documents(df, at).collect()) == [("a.txt", 3), ("sub/_b.txt", 0), ("sub/å.txt", 0)]
    assert names(at) == ["a.txt", "sub/_b.txt", "sub/å.txt"]
    sink.write_documents(spark.createDataFrame([(b"nytt", f"{at}/a.txt", 1)], "content binary, dest string, extra int"), at)
    assert names(at) == ["a.txt", "sub/_b.txt", "sub/å.txt"] and Path(at, "a.txt").read_bytes() == b"nytt"
    assert sink.write_documents(df.limit(0), at).collect() == []


def test_one_dest_for_two_documents(spark, tmp_path):
    df = spark.createDataFrame([(f"{tmp_path}/ut/a", b"1"), (f"{tmp_path}/ut/a", b"2"), (f"{tmp_path}/ut/b", b"3")], "dest string, content binary")
    with pytest.raises(ValueError, match="2 documents"):
        sink.write_documents(df, f"{tmp_path}/ut")
    assert names(tmp_path / "ut") == []


def test_failed_job_touches_nothing(spark, tmp_path):
    fails = F.when(F.col("id") == 7, F.raise_error(F.lit("no"))).otherwise(F.lit("x"))
    df = spark.range(0, 100, 1, 4).select(F.concat(F.lit(f"{tmp_path}/ut/"), F.col("id").cast("string")).alias("dest"), fails.cast("binary").alias("content"))
    with pytest.raises(Exception, match="no"):
        sink.write_documents(df, f"{tmp_path}/ut")
    assert names(tmp_path / "ut") == []


def attempt(folder, rows):
    return sink.StagingWriter(folder).write(iter([pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["dest", "content"])]))


def test_only_accepted_attempts_count_and_publication_resumes(spark, tmp_path):
    at = str(tmp_path / "ut")
    folder = f"{at}/.staged-1"
    attempt(folder, [(f"{at}/a", b"lost"), (f"{at}/b", b"lost")])  # a speculative copy that Spark doesn't accept
    good = attempt(folder, [(f"{at}/a", b"1"), (f"{at}/b", b"2")])
    sink.StagingWriter(folder).commit([good, None, attempt(folder, [])])
    Path(good.listed).parent.joinpath("0").rename(f"{at}/a")  # the driver was lost when one move had happened
    attempt(f"{at}/.staged-2", [(f"{at}/c", b"never committed")])
    sink.finish_writes(spark, at)
    assert names(at) == ["a", "b"] and [Path(at, n).read_bytes() for n in "ab"] == [b"1", b"2"]


def test_query_broadcasts_no_texts(spark, data):
    """What is read in tasks is measured by its paths, so an unhinted join would broadcast every text."""
    from tonguemill.plans import durable

    df = durable.document_sink(spark, data)
    assert df.count() == spark.read.parquet(f"{data}/documents.parquet").count()
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


RETRIED = """
import sys
from pathlib import Path
from pyspark import TaskContext
from pyspark.sql import SparkSession
from tonguemill.sources import sink
at = sys.argv[1]
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.execution.arrow.maxRecordsPerBatch", "3").getOrCreate()

def rows(batches):
    for k, b in enumerate(batches):
        yield b
        if k == 1 and TaskContext.get().attemptNumber() < 2:
            raise RuntimeError("lost")

df = spark.range(0, 40, 1, 2).selectExpr(f"concat('{at}/d', id) AS dest", "cast(cast(id AS string) AS binary) AS content")
print("written", sink.write_documents(df.mapInArrow(rows, df.schema), at).count())
"""


def test_retried_tasks_leave_one_file_for_each_dest(tmp_path):
    at = tmp_path / "ut"
    done = subprocess.run([sys.executable, "-c", RETRIED, str(at)], capture_output=True, text=True, timeout=200, cwd=Path(__file__).resolve().parents[1])
    assert "written 40" in done.stdout, done.stderr[-2000:]
    assert names(at) == sorted(f"d{i}" for i in range(40)) and all((at / f"d{i}").read_text() == str(i) for i in range(40))
