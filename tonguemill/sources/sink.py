"""The document sink: a data source writer whose tasks stage files and whose commit decides which of them count.

Each attempt of a task writes its documents below a hidden folder of its own and a list of them. Spark hands the lists of the attempts that
it accepts to the commit, which writes them down; what other attempts have left is never looked at. Then tasks move the staged
files to their places. A move that has happened is skipped, so an interrupted publication is finished by doing it again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tonguemill.core.config import open_folder
from tonguemill.core.shared import hadoop_path, own_folder, put

STAGED, COMMITTED = ".staged-", "committed"
#: Documents that one task moves.
MOVES = 1000
_LISTED = pa.schema([("staged", pa.string()), ("dest", pa.string()), ("bytes", pa.int64())])
LISTED = "staged string, dest string, bytes long"


@dataclass
class Staged(WriterCommitMessage):
    """What an attempt has written: its list, and how many documents that names. The driver gets one for each task."""

    listed: str
    n: int


class StagingWriter(DataSourceArrowWriter):
    """Rows (dest, content), in any order of columns."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        own = f"{self.folder}/{uuid.uuid4().hex}"
        fs, path = open_folder(own)
        fs.create_dir(path, recursive=True)
        rows: list[tuple[str, str, int]] = []
        for batch in iterator:
            dests, contents = batch.column("dest"), batch.column("content")
            for dest, content in zip(dests, contents, strict=True):
                data = content.as_buffer() if content.is_valid else b""
                with fs.open_output_stream(f"{path}/{len(rows)}", compression=None) as out:
                    out.write(data)
                rows.append((f"{own}/{len(rows)}", dest.as_py(), len(data)))
        table = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _LISTED.types, strict=True)], schema=_LISTED) if rows else _LISTED.empty_table()
        put(f"{own}/list.parquet", lambda out: pyarrow.parquet.write_table(table, out))
        return Staged(f"{own}/list.parquet", len(rows))

    def commit(self, messages: list[Staged | None]) -> None:
        lists = [m.listed for m in messages if m is not None and m.n]
        put(f"{self.folder}/{COMMITTED}", lambda out: out.write("\n".join(lists).encode()))

    def abort(self, messages: list[Staged | None]) -> None:
        fs, path = open_folder(self.folder)
        if fs.get_file_info(path).type == pyarrow.fs.FileType.Directory:
            fs.delete_dir(path)


class DocumentSink(DataSource):
    """`df.write.format("staged_documents").option("folder", ...)`; see write_documents."""

    @classmethod
    def name(cls) -> str:
        return "staged_documents"

    def writer(self, schema, overwrite: bool) -> StagingWriter:
        return StagingWriter(self.options["folder"])


def _move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for staged, dest in zip(batch.column("staged").to_pylist(), batch.column("dest").to_pylist(), strict=True):
            fs, at = open_folder(staged)
            if fs.get_file_info(at).type == pyarrow.fs.FileType.File:
                _, to = open_folder(dest)
                fs.create_dir(to.rsplit("/", 1)[0], recursive=True)
                fs.move(at, to)
        yield batch.select(["dest", "bytes"])


def _publish(spark: SparkSession, folder: str) -> DataFrame | None:
    """(dest, bytes) of what was moved, from a table of its own; None if nothing was written."""
    fs, path = open_folder(f"{folder}/{COMMITTED}")
    with fs.open_input_stream(path) as f:
        lists = [x for x in f.read().decode().split("\n") if x]
    if not lists:
        return None
    listed = spark.read.schema(LISTED).parquet(*lists)
    if twice := listed.groupBy("dest").count().where("count > 1").first():
        raise ValueError(f"{twice['count']} documents are to be written to {twice.dest}")
    at = own_folder(spark, "written")
    moved = listed.repartition(max(1, -(-listed.count() // MOVES))).mapInArrow(_move, "dest string, bytes long")
    moved.write.mode("overwrite").parquet(at)
    return spark.read.schema("dest string, bytes long").parquet(at)


def finish_writes(spark: SparkSession, out_dir: str) -> None:
    """Ends what earlier jobs have left in the output folder: publishes what was committed, removes what wasn't. Not for use while another
    job writes there."""
    fs, root = hadoop_path(spark, out_dir)
    if fs.exists(root):
        for entry in fs.listStatus(root):
            if entry.getPath().getName().startswith(STAGED):
                folder = entry.getPath().toString()
                if fs.exists(hadoop_path(spark, f"{folder}/{COMMITTED}")[1]):
                    _publish(spark, folder)
                fs.delete(entry.getPath(), True)


def write_documents(df: DataFrame, out_dir: str) -> DataFrame:
    """Writes content to dest, below out_dir, for each row of (dest, content), and returns (dest, bytes) of what was written.

    Nothing is at its dest before all of it is staged, so a job that fails touches no dest. Two rows of one dest are an error before
    anything is moved; null content is an empty file; an empty table writes nothing. What stood at a dest is replaced. Folders must be
    ones that the executors share: local paths on one machine, else a URI that pyarrow opens.
    """
    spark = df.sparkSession
    fs, root = hadoop_path(spark, out_dir)
    fs.mkdirs(root)
    finish_writes(spark, out_dir)
    spark.dataSource.register(DocumentSink)
    folder = f"{out_dir.rstrip('/')}/{STAGED}{uuid.uuid4().hex}"
    df.select("dest", F.col("content").cast("binary").alias("content")).write.format(DocumentSink.name()).option("folder", folder).mode("append").save()
    try:
        written = _publish(spark, folder)
    finally:
        fs.delete(hadoop_path(spark, folder)[1], True)
    return written if written is not None else spark.createDataFrame([], "dest string, bytes long")
