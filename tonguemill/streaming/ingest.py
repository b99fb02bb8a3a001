"""Continuous ingest: every document of a growing folder is handled once, whatever is lost or replayed on the way.

The source is a listing that is written down: what is new in the folder becomes a numbered entry, a stream's offset is an entry's number,
so a batch that runs again reads the same files. Unlike Spark's own file source it has files whose names begin with `_`, and empty ones.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from tonguemill.core.config import open_folder
from tonguemill.core.shared import hadoop_path, put
from tonguemill.sources.files import FILES, keep_documents
from tonguemill.sources.parts import blocks

#: Files and bytes that one task reads, about.
FILES_A_TASK, BYTES_A_TASK = 500, 64 << 20
#: Rows of a row group of an entry.
GROUP = 2000
_ENTRY = pa.schema([("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64())])
_FILE = pa.schema([*_ENTRY, ("content", pa.binary()), ("entry", pa.int32())])


class Slice(InputPartition):
    """Rows [first, end) of an entry; the driver deals out numbers, not names."""

    def __init__(self, entry: int, first: int, end: int):
        self.entry, self.first, self.end = entry, first, end


class ListingReader(DataSourceStreamReader):
    """New files below `folder`, each once, by entries that are kept in `log`."""

    def __init__(self, folder: str, log: str):
        self.folder, self.log, self.known, self.last = folder, log, set(), 0

    def _entry(self, n: int, column: str) -> list:
        fs, path = open_folder(f"{self.log}/{n:09}.parquet")
        with fs.open_input_file(path) as f:
            return pyarrow.parquet.read_table(f, columns=[column])[column].to_pylist()

    def _slice(self, n: int, first: int, end: int) -> pa.Table:
        """Rows [first, end) of an entry, from the row groups that hold them, so a task's reading doesn't grow with the entry."""
        fs, path = open_folder(f"{self.log}/{n:09}.parquet")
        with fs.open_input_file(path) as f:
            file, at, groups, before = pyarrow.parquet.ParquetFile(f), 0, [], 0
            for k in range(file.num_row_groups):
                rows = file.metadata.row_group(k).num_rows
                if at + rows > first and at < end:
                    before = at if not groups else before
                    groups.append(k)
                at += rows
            return file.read_row_groups(groups).slice(first - before, end - first)

    def _catch_up(self) -> None:
        fs, path = open_folder(self.log)
        numbers = [int(i.base_name[:9]) for i in fs.get_file_info(pyarrow.fs.FileSelector(path, allow_not_found=True)) if not i.base_name.startswith(".")]
        for n in range(self.last + 1, max(numbers, default=0) + 1):
            self.known.update(self._entry(n, "path"))
            self.last = n

    def initialOffset(self) -> dict:
        return {"entry": 0}

    def latestOffset(self) -> dict:
        """Writes down what is new, if anything is. Names that begin with a dot, or stand below one, are left out: they may be half written."""
        self._catch_up()
        fs, root = open_folder(self.folder)
        found = fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True, allow_not_found=True))
        bare = self.folder.rstrip("/")
        rows = [(bare + i.path[len(root.rstrip("/")) :], i.mtime, i.size) for i in found if i.type == pyarrow.fs.FileType.File and "/." not in i.path[len(root.rstrip("/")) :]]
        rows = sorted(r for r in rows if r[0] not in self.known)
        if rows:
            table = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ENTRY.types, strict=True)], schema=_ENTRY)
            put(f"{self.log}/{self.last + 1:09}.parquet", lambda out: pyarrow.parquet.write_table(table, out, row_group_size=GROUP))
            self._catch_up()
        return {"entry": self.last}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        out = []
        for n in range(start["entry"] + 1, end["entry"] + 1):
            first, size, sizes = 0, 0, self._entry(n, "length")
            for i, length in enumerate(sizes):
                if i > first and (i - first >= FILES_A_TASK or size + length > BYTES_A_TASK):
                    out.append(Slice(n, first, i))
                    first, size = i, 0
                size += length
            out.append(Slice(n, first, len(sizes)))
        return out

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        rows = self._slice(partition.entry, partition.first, partition.end)
        yield from blocks(self._contents(rows, partition.entry), _FILE)

    def _contents(self, rows: pa.Table, entry: int) -> Iterator[tuple]:
        for path, mtime, length in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            fs, at = open_folder(path)
            try:
                with fs.open_input_stream(at, compression=None) as f:
                    content = f.read()
            except FileNotFoundError:  # gone since it was listed
                continue
            yield path, mtime, length, content, entry


class DocumentStream(DataSource):
    """`spark.readStream.format("document_listing").option("folder", ...).option("log", ...)`"""

    @classmethod
    def name(cls) -> str:
        return "document_listing"

    def schema(self) -> str:
        return f"{FILES}, entry int"

    def streamReader(self, schema) -> ListingReader:
        return ListingReader(self.options["folder"], self.options["log"])


def document_stream(spark: SparkSession, in_dir: str, log: str, out_dir: str | None = None) -> DataFrame:
    """A stream of (path, modificationTime, length, content, entry, name, ext) of the folder's documents."""
    spark.dataSource.register(DocumentStream)
    return keep_documents(spark.readStream.format(DocumentStream.name()).option("folder", in_dir).option("log", log).load(), in_dir, out_dir)


def ingest_stream(spark: SparkSession, in_dir: str, checkpoint: str, handle: Callable[[DataFrame, int], None], out_dir: str | None = None) -> StreamingQuery:
    """Runs over what is new and stops; call it again, or on a schedule, for more. `handle` gets a batch of files and its number. A batch
    that was lost on its way comes again with the same number and the same files, in a run of its own; what is newer comes with the next."""
    docs = document_stream(spark, in_dir, f"{checkpoint}/listing", out_dir)
    return docs.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handle).start()


def ingest_table(spark: SparkSession, in_dir: str, table_dir: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], out_dir: str | None = None) -> StreamingQuery:
    """Appends transform(files) to a Parquet table, exactly once, and stops. transform must keep the column `entry`.

    A ledger beside the table names the batches that are done, by the stream's id and the batch's number, so one that is replayed changes
    nothing and computes nothing. A batch that was lost half-way replaces what it had written, as each entry is a partition that is
    overwritten whole. The listing belongs to the table: with a new checkpoint the same entries come again and replace themselves.
    """

    def handle(batch: DataFrame, n: int) -> None:
        fs, meta = open_folder(f"{checkpoint}/metadata")
        with fs.open_input_stream(meta) as f:
            done = f"{table_dir}/_batches/{json.loads(f.read())['id']}-{n}"
        own, path = hadoop_path(batch.sparkSession, done)
        if own.exists(path):
            return
        transform(batch).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("entry").parquet(table_dir)
        put(done, lambda out: None)

    docs = document_stream(spark, in_dir, f"{table_dir}/_listing", out_dir)
    return docs.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handle).start()
