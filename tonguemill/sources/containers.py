"""Office containers: parts out of ZIP files and back, workbook cells, new documents.

Python touches only container bytes; what happens to the parts is DataFrame work.
"""

from __future__ import annotations

import io
import itertools
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tonguemill.functions.scalars import TEXT_PARTS, decode_xml_entities, escape_xml
from tonguemill.operators.ooxml import _all
from tonguemill.sources.parts import BROKEN, blocks, open_container, pieces, read_parts, read_pieces, rows_of, source_column


UNREADABLE = "Filen kan ikke leses: {}"


def read_ooxml_parts(files: DataFrame, dialect: str) -> DataFrame:
    """The parts that hold text of files (doc_id, and path or content); no others are inflated."""
    return read_parts(files, TEXT_PARTS[dialect].replace(r"\z", r"\Z"))


def repack_ooxml(files: DataFrame, new_parts: DataFrame) -> DataFrame:
    """(doc_id, content, error): each container with its new parts (doc_id, part, xml) in place, all other entries as they were.

    A container that can't be read has no content but an error, and leaves the others alone.
    """

    def rewrite(z: zipfile.ZipFile, w: zipfile.ZipFile, changes: list[tuple]) -> None:
        new = dict(changes)
        for info in z.infolist():
            w.writestr(info, new[info.filename].encode() if info.filename in new else z.read(info), zipfile.ZIP_DEFLATED)

    return _repacked(files, new_parts.select("doc_id", "part", "xml"), rewrite)


def _repacked(files: DataFrame, changes: DataFrame, rewrite: Callable[[zipfile.ZipFile, zipfile.ZipFile, list[tuple]], None]) -> DataFrame:
    """(doc_id, content, error): every container rewritten with its changes (doc_id, ...). One shuffle; a container's changes come right
    before it, and the task that rewrites it holds them."""
    kind, source = files.schema["doc_id"].dataType, source_column(files)
    fields = [f for f in changes.schema if f.name != "doc_id"]
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("content", pa.binary()), ("error", pa.string())])
    none = lambda f: F.lit(None).cast(f.dataType).alias(f.name)
    first = changes.select("doc_id", F.lit(0).alias("__k"), *[f.name for f in fields], none(files.schema[source]).alias("__source"))
    both = first.union(files.select("doc_id", F.lit(1).alias("__k"), *[none(f) for f in fields], source))

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        own, held = None, []
        for doc, k, *change, container in rows_of(batches):
            if doc != own:
                own, held = doc, []
            if k == 0:
                held.append(tuple(change))
                continue
            to = io.BytesIO()
            try:
                with open_container(container) as z, zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as w:
                    rewrite(z, w, held)
                yield doc, to.getvalue(), None
            except BROKEN as e:
                yield doc, None, UNREADABLE.format(e)

    dealt = both.repartition("doc_id").sortWithinPartitions("doc_id", "__k")
    return dealt.mapInArrow(lambda batches: blocks(done(batches), schema), f"doc_id {kind.simpleString()}, content binary, error string")


CELL, CELL_OPENS = re.compile(r"(?s)<c\b[^>]*?(?:/>|>.*?</c>)"), re.compile(r"<c\b|<\Z")
SHARED, SHARED_OPENS = re.compile(r"(?s)<si\b(?:[^>]*/>|.*?</si>)"), re.compile(r"<si\b|<s?\Z")
SHEETS = r"\Axl/worksheets/[^/]+\.xml\Z"


def _cells(pieces: DataFrame) -> DataFrame:
    rows = pieces.select("doc_id", F.col("part").alias("sheet"), F.col("idx").alias("cell_idx"), F.col("text").alias("c"))
    head = F.regexp_extract("c", r"\A(<c\b[^>]*>)", 1)
    attr = lambda k: F.regexp_extract(head, rf'\s{k}="([^"]*)"', 1)
    letters = F.regexp_extract(attr("r"), r"\A([A-Z]+)", 1)
    col = F.aggregate(F.split(letters, ""), F.lit(0), lambda acc, x: F.when(x == "", acc).otherwise(acc * 26 + F.ascii(x) - 64)) - 1
    inner = lambda tag: F.regexp_extract("c", rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)
    return rows.select("doc_id", "sheet", "cell_idx", (F.regexp_extract(attr("r"), r"([0-9]+)\z", 1).try_cast("int") - 1).alias("row"), col.alias("col"), F.when(attr("t") == "", "n").otherwise(attr("t")).alias("type"), F.when(F.col("c").rlike(r"<f\b"), decode_xml_entities(inner("f"))).alias("formula"), inner("v").alias("v"), F.array_join(F.transform(_all(F.col("c"), r"(?s)<t(?:\s[^>]*)?>.*?</t>"), lambda t: F.regexp_extract(t, r"(?s)>(.*)</t>", 1)), "").alias("t"))


def read_workbook_cells(files: DataFrame) -> DataFrame:
    """cells (doc_id, sheet, cell_idx, row, col, type, formula, value) of every sheet; shared strings are looked up by an equi-join.

    Types: s for shared and inline strings, str for formula strings, others as they stand. Sheets and shared strings are read cell by cell.
    """
    cells = _cells(read_pieces(files, SHEETS, CELL, CELL_OPENS))
    shared = read_pieces(files, r"\Axl/sharedStrings\.xml\Z", SHARED, SHARED_OPENS)
    text = F.array_join(F.transform(_all(F.col("text"), r"(?s)<t(?:\s[^>]*)?>.*?</t>"), lambda t: F.regexp_extract(t, r"(?s)>(.*)</t>", 1)), "")
    looked = cells.join(shared.select("doc_id", F.col("idx").cast("string").alias("v"), F.lit("s").alias("type"), text.alias("shared")), ["doc_id", "v", "type"], "left")
    value = F.when(F.col("type") == "s", F.col("shared")).when(F.col("type") == "inlineStr", F.col("t")).otherwise(F.col("v"))
    return looked.select("doc_id", "sheet", "cell_idx", "row", "col", F.when(F.col("type") == "inlineStr", "s").otherwise(F.col("type")).alias("type"), "formula", decode_xml_entities(value).alias("value")).where("row is not null and value <> ''")


def _told(cell: str, value: str) -> str:
    """A cell with an inline string, its other attributes kept."""
    head = re.sub(r'\st="[^"]*"', "", re.match(r"(<c\b[^>]*?)/?>", cell)[1]).rstrip()
    return f'{head} t="inlineStr"><is><t xml:space="preserve">{value}</t></is></c>'


def repack_workbook(files: DataFrame, cells: DataFrame) -> DataFrame:
    """(doc_id, content, error): the workbook with changed cells (doc_id, sheet, cell_idx, value, changed) as inline strings.

    A workbook meets its changed cells alone; sheets are rewritten cell by cell, from the old container into the new one.
    """

    def rewrite(z: zipfile.ZipFile, w: zipfile.ZipFile, changes: list[tuple]) -> None:
        new: dict[str, dict[int, str]] = {}
        for part, at, value in changes:
            new.setdefault(part, {})[at] = value
        for info in z.infolist():
            if info.filename not in new:
                w.writestr(info, z.read(info), zipfile.ZIP_DEFLATED)
                continue
            own, k = new[info.filename], 0
            entry = zipfile.ZipInfo(info.filename, info.date_time)
            entry.compress_type = zipfile.ZIP_DEFLATED
            with w.open(entry, "w", force_zip64=True) as sheet:
                for before, cell in pieces(z, info.filename, CELL, CELL_OPENS):
                    sheet.write((before + (_told(cell, own[k]) if cell and k in own else cell)).encode())
                    k += bool(cell)

    changed = cells.where("changed").select("doc_id", F.col("sheet").alias("part"), "cell_idx", escape_xml(F.col("value")).alias("value"))
    return _repacked(files, changed, rewrite)


# The other parts of a minimal word-processing document.
CONTENT_TYPES = """<?xml version="1.0" encoding="UTF-8" standalone="yes"?>
<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.styles+xml"/></Types>"""
RELATIONSHIPS = """<?xml version="1.0" encoding="UTF-8" standalone="yes"?>
<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>"""
DOCUMENT_RELATIONSHIPS = """<?xml version="1.0" encoding="UTF-8" standalone="yes"?>
<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>"""
STYLES = """<?xml version="1.0" encoding="UTF-8" standalone="yes"?>
<w:styles xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:docDefaults><w:rPrDefault><w:rPr><w:rFonts w:ascii="Calibri" w:hAnsi="Calibri" w:cs="Calibri"/><w:sz w:val="22"/><w:szCs w:val="22"/></w:rPr></w:rPrDefault><w:pPrDefault><w:pPr><w:spacing w:after="0" w:line="240" w:lineRule="auto"/></w:pPr></w:pPrDefault></w:docDefaults></w:styles>"""
NEW_DOCX = {"[Content_Types].xml": CONTENT_TYPES, "_rels/.rels": RELATIONSHIPS, "word/_rels/document.xml.rels": DOCUMENT_RELATIONSHIPS, "word/styles.xml": STYLES}


def pack_parts(parts: DataFrame) -> DataFrame:
    """(doc_id, content): a container for each document, with its parts (doc_id, part, xml)."""

    kind = parts.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("content", pa.binary())])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for doc, own in itertools.groupby(rows_of(batches), key=lambda r: r[0]):
            yield doc, _zipped((name, xml) for _, name, xml in own)

    rows = parts.select("doc_id", "part", "xml").repartition("doc_id").sortWithinPartitions("doc_id", "part", "xml")
    return rows.mapInArrow(lambda batches: blocks(packed(batches), schema), f"doc_id {kind.simpleString()}, content binary")


def _zipped(entries: Iterable[tuple[str, str]]) -> bytes:
    to = io.BytesIO()
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in entries:
            z.writestr(zipfile.ZipInfo(name), text.encode(), zipfile.ZIP_DEFLATED)
    return to.getvalue()


def build_docx(documents: DataFrame) -> DataFrame:
    """(doc_id, content) from body parts (doc_id, xml)."""
    fixed, kind = dict(NEW_DOCX), documents.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("content", pa.binary())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        return ((doc, _zipped({**fixed, "word/document.xml": xml}.items())) for doc, xml in rows_of(batches))

    return documents.select("doc_id", "xml").mapInArrow(lambda batches: blocks(made(batches), schema), f"doc_id {kind.simpleString()}, content binary")


def write_table(df: DataFrame, path: str, mode: str = "append") -> None:
    """The table sink: Parquet by output extension."""
    df.write.mode(mode).partitionBy("out_ext").parquet(path)
