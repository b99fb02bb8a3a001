"""Parts of ZIP containers: read by ranges, only those that are asked for, and long ones piece by piece.

A container is given by its bytes or by its path. With a path only the directory at its end and the wanted parts are read, so a file may be
larger than a value can be. `office_parts` is a data source over a folder that takes filters on the part's name down to the directory.
"""

from __future__ import annotations

import codecs
import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from tonguemill.core.config import open_folder

#: What a damaged, encrypted or otherwise unreadable container raises.
BROKEN = (zipfile.BadZipFile, zlib.error, struct.error, TypeError, ValueError, KeyError, NotImplementedError, RuntimeError, EOFError, OSError)
#: Bytes of files that a task of the data source reads, bytes that are inflated at once, and pieces of a block of rows.
BYTES_A_TASK, PIECE, BLOCK = 128 << 20, 1 << 20, 10_000
#: Bytes of a block, about, and rows that are taken out of a batch at once.
HELD, ROWS = 4 << 20, 64


def open_container(source: bytes | str | None) -> zipfile.ZipFile:
    if isinstance(source, str):
        fs, path = open_folder(source)
        return zipfile.ZipFile(fs.open_input_file(path))
    return zipfile.ZipFile(io.BytesIO(source))


def inflate(z: zipfile.ZipFile, name: str) -> bytes:
    """A part whole; every part that is read goes through here or through pieces()."""
    return z.read(name)


def pieces(z: zipfile.ZipFile, name: str, pattern: re.Pattern, opening: re.Pattern) -> Iterator[tuple[str, str]]:
    """(text before, match) of every match in a part, in order, and (rest, "") at the end, holding no more than a piece and a match.

    `opening` finds where a match may begin, also one that is cut at the end. What follows a match must not change it.
    """
    decoder, held = codecs.getincrementaldecoder("utf-8")("replace"), ""
    with z.open(name) as f:
        while True:
            raw = f.read(PIECE)
            held += decoder.decode(raw, not raw)
            at = 0
            if not raw:
                for m in pattern.finditer(held):
                    yield held[at : m.start()], m[0]
                    at = m.end()
                yield held[at:], ""
                return
            # what is before the next opening can't be in a match any more; one that doesn't match yet may need what comes
            while (begin := opening.search(held, at)) and (m := pattern.match(held, begin.start())):
                yield held[at : m.start()], m[0]
                at = m.end()
            keep = begin.start() if begin else len(held)
            if keep > at:
                yield held[at:keep], ""
            held = held[keep:]


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows as tuples, a few at a time, so a batch of long values isn't held twice."""
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            yield from zip(*(c.to_pylist() for c in batch.slice(a, ROWS).columns), strict=True)


def blocks(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Tuples as batches of at most BLOCK rows and about HELD bytes."""
    held, size = [], 0
    give = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, (bytes, str)))
        if len(held) >= BLOCK or size > HELD:
            yield give()
            held, size = [], 0
    if held:
        yield give()


def source_column(files: DataFrame) -> str:
    return "path" if "path" in files.columns else "content"


def read_parts(files: DataFrame, pattern: str = r"\.(?:xml|rels)$") -> DataFrame:
    """(doc_id, part, part_idx, xml) of the parts of files (doc_id, and path or content) whose name matches; a broken container gives none.

    Only those parts are inflated.
    """
    wanted, kind = re.compile(pattern), files.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("part", pa.string()), ("part_idx", pa.int32()), ("xml", pa.string())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for doc, source in rows_of(batches):
            try:
                with open_container(source) as z:
                    got = [(doc, n, i, inflate(z, n).decode("utf-8", "replace")) for i, n in enumerate(z.namelist()) if wanted.search(n)]
            except BROKEN:  # repack_ooxml says why
                continue
            yield from got

    return files.select("doc_id", source_column(files)).mapInArrow(lambda batches: blocks(found(batches), schema), f"doc_id {kind.simpleString()}, part string, part_idx int, xml string")


def read_pieces(files: DataFrame, parts: str, pattern: re.Pattern, opening: re.Pattern) -> DataFrame:
    """(doc_id, part, idx, text) of every match of a pattern in the parts whose name matches, numbered in each part.

    Parts are inflated and searched piece by piece, so a sheet of millions of cells is never one string. A part that turns out to be damaged
    gives what stands before the damage; repack_workbook reports it.
    """
    wanted, kind = re.compile(parts), files.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("part", pa.string()), ("idx", pa.int32()), ("text", pa.string())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for doc, source in rows_of(batches):
            try:
                with open_container(source) as z:
                    for name in filter(wanted.search, z.namelist()):
                        yield from ((doc, name, i, text) for i, text in enumerate(text for _, text in pieces(z, name, pattern, opening) if text))
            except BROKEN:
                continue

    return files.select("doc_id", source_column(files)).mapInArrow(lambda batches: blocks(found(batches), schema), f"doc_id {kind.simpleString()}, part string, idx int, text string")


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class PartsReader(DataSourceReader):
    """Containers of a folder by their paths; names of parts that a filter rules out are never inflated."""

    def __init__(self, options):
        self.folder, self.extensions, self.filters = options["folder"], tuple(options.get("extensions", ".docx,.pptx,.xlsx").split(",")), []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if f.__class__ in (EqualTo, In, StringStartsWith, StringEndsWith, StringContains) and f.attribute == ("part",):
                self.filters.append(f)
            else:
                yield f

    def wants(self, name: str) -> bool:
        test = {EqualTo: lambda v: name == v, In: lambda v: name in v, StringStartsWith: name.startswith, StringEndsWith: name.endswith, StringContains: lambda v: v in name}
        return all(test[type(f)](f.value) for f in self.filters)

    def partitions(self) -> list[Files]:
        """Files by size; a task gets about BYTES_A_TASK of them."""
        fs, root = open_folder(self.folder)
        found = fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True, allow_not_found=True))
        out, paths, size = [], [], 0
        for i in sorted((i for i in found if i.type == pyarrow.fs.FileType.File and i.path.lower().endswith(self.extensions)), key=lambda i: i.path):
            if paths and size + i.size > BYTES_A_TASK:
                out.append(Files(paths))
                paths, size = [], 0
            paths.append(self.folder.rstrip("/") + i.path[len(root.rstrip("/")) :])
            size += i.size
        return [*out, Files(paths)] if paths else out

    def read(self, partition: Files | None) -> Iterator[tuple]:
        for path in partition.paths if partition else ():
            try:
                with open_container(path) as z:
                    for i, info in enumerate(z.infolist()):
                        if self.wants(info.filename):
                            yield path, info.filename, i, info.file_size, inflate(z, info.filename)
            except BROKEN as e:
                if not self.filters:  # a damaged file has no parts that a filter could ask for
                    yield path, None, None, None, str(e).encode()


class OfficeParts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "office_parts"

    def schema(self) -> str:
        return "path string, part string, part_idx int, bytes long, content binary"

    def reader(self, schema) -> PartsReader:
        return PartsReader(self.options)


def parts_of(spark: SparkSession, folder: str, extensions: tuple[str, ...] = (".docx", ".pptx", ".xlsx")) -> DataFrame:
    """(path, part, part_idx, bytes, content) of the containers below a folder. Filters on part (=, IN, LIKE with a fixed beginning, end or
    middle) decide what is inflated. Read without such a filter, a container that can't be read is a row without part, with the reason."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(OfficeParts)
    return spark.read.format(OfficeParts.name()).option("folder", folder).option("extensions", ",".join(extensions)).load()


def text_parts_of(spark: SparkSession, folder: str, dialect: str) -> DataFrame:
    """(doc_id, part, part_idx, xml): what read_ooxml_parts gives, for the containers of a folder."""
    from tonguemill.functions.scalars import is_text_part

    head = {"docx": "word/", "pptx": "ppt/"}[dialect]
    rows = parts_of(spark, folder, (f".{dialect}",)).where(F.col("part").startswith(head) & F.col("part").endswith(".xml")).where(is_text_part(F.col("part"), dialect))
    return rows.select(F.col("path").alias("doc_id"), "part", "part_idx", F.make_valid_utf8(F.col("content").cast("string")).alias("xml"))
