"""Containers are packed and repacked in Arrow batches, a few at a time."""

import io
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tonguemill.plans import catalogue
from tonguemill.sources import containers, parts


def test_blocks_are_bounded():
    schema = pa.schema([("doc_id", pa.int64()), ("content", pa.binary())])
    out = list(parts.blocks(((i, b"x" * (1 << 20)) for i in range(12)), schema))
    assert sum(b.num_rows for b in out) == 12 and max(b.nbytes for b in out) < 6 << 20


@pytest.mark.parametrize("name", ["pptx_round_trip", "workbook_round_trip"])
def test_no_group_is_a_frame_of_its_own(spark, data, name):
    plan = catalogue.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "CoGroup" not in plan


def test_pack_and_repack_over_batches(spark):
    rows = [(d, f"word/p{i}.xml", f"<x>{d} {i}</x>") for d in (1, 2, None) for i in range(5)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        made = containers.pack_parts(spark.createDataFrame(rows, "doc_id long, part string, xml string"))
        new = spark.createDataFrame([(2, "word/p3.xml", "new"), (2, "word/p1.xml", "also"), (7, "word/p1.xml", "of no file")], "doc_id long, part string, xml string")
        files = made.union(spark.createDataFrame([(8, b"broken")], made.schema)).union(made.where("doc_id = 2"))
        got = containers.repack_ooxml(files, new).orderBy(F.col("doc_id")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r.doc_id, r.error is None) for r in got] == [(None, True), (1, True), (2, True), (2, True), (8, False)]
    for r in got[:4]:
        with zipfile.ZipFile(io.BytesIO(r.content)) as z:
            want = {p: x for d, p, x in rows if d == r.doc_id} | ({"word/p3.xml": "new", "word/p1.xml": "also"} if r.doc_id == 2 else {})
            assert {n: z.read(n).decode() for n in z.namelist()} == want
