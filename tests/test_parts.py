"""Parts of containers: what is inflated, ranged reads, sheets piece by piece."""

import io
import random
import re
import resource
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.test_sources import pack
from tonguemill.sources import containers, parts


def spoilt(content, name):
    """The container with one part that can't be inflated."""
    raw = bytearray(content)
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        at = z.getinfo(name).header_offset + 30 + len(name)
    raw[at : at + 4] = b"\xff\xff\xff\xff"
    return bytes(raw)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "_sub").mkdir(parents=True)
    body = {"word/document.xml": "<w:p>é</w:p>", "word/header1.xml": "<w:p>h</w:p>", "word/styles.xml": "<s>" + "y" * 99 + "</s>", "word/media/a.png": "raw"}
    (tmp_path / "in" / "a.docx").write_bytes(spoilt(pack(body), "word/styles.xml"))
    (tmp_path / "in" / "_sub" / "b.DOCX").write_bytes(pack(body))
    (tmp_path / "in" / "bad.docx").write_bytes(b"no container")
    (tmp_path / "in" / "c.txt").write_bytes(b"")
    return str(tmp_path / "in")


def test_only_text_parts_are_inflated(spark, folder, monkeypatch):
    rows = [(f"{folder}/a.docx",), (f"{folder}/_sub/b.DOCX",), (f"{folder}/bad.docx",), (None,)]
    by_path = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, path string")
    want = [(0, "word/document.xml", 0, "<w:p>é</w:p>"), (0, "word/header1.xml", 1, "<w:p>h</w:p>"), (1, "word/document.xml", 0, "<w:p>é</w:p>"), (1, "word/header1.xml", 1, "<w:p>h</w:p>")]
    assert sorted(map(tuple, containers.read_ooxml_parts(by_path, "docx").collect())) == want
    by_folder = parts.text_parts_of(spark, folder, "docx")
    assert sorted((r.doc_id.rsplit("/", 1)[1], r.part, r.xml) for r in by_folder.collect()) == sorted((n, p, x) for n in ("a.docx", "b.DOCX") for _, p, _, x in want[:2])
    plan = by_folder._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan
    got = []
    monkeypatch.setattr(parts, "inflate", lambda z, name, own=parts.inflate: got.append(name) or own(z, name))
    reader = parts.PartsReader({"folder": folder, "extensions": ".docx"})
    left = list(reader.pushFilters([parts.StringStartsWith(("part",), "word/h"), parts.IsNotNull(("part",)) if hasattr(parts, "IsNotNull") else parts.StringEndsWith(("path",), "x")]))
    assert len(left) == 1
    read = [r for p in reader.partitions() for r in reader.read(p)]
    assert len(read) == 2 and got == ["word/header1.xml"] * 2


def test_unreadable_files_are_rows_without_a_filter(spark, folder):
    got = {(r.path.rsplit("/", 1)[1], r.part) for r in parts.parts_of(spark, folder).collect()}
    assert {("bad.docx", None), ("a.docx", None), ("b.DOCX", "word/media/a.png")} <= got


def test_files_are_dealt_by_size(tmp_path, monkeypatch):
    monkeypatch.setattr(parts, "BYTES_A_TASK", 10)
    for i, n in enumerate([4, 4, 4, 30, 1, 0]):
        (tmp_path / f"{i}.docx").write_bytes(b"x" * n)
    assert [len(p.paths) for p in parts.PartsReader({"folder": str(tmp_path)}).partitions()] == [2, 1, 1, 2]


def test_pieces_are_what_the_whole_has(monkeypatch):
    rng = random.Random(2)
    for size in (1, 3, 7, 50):
        monkeypatch.setattr(parts, "PIECE", size)
        for _ in range(60):
            xml = "".join(rng.choice(["<c/>", "<c r='1'><v>é😀</v></c>", "<cols><col/></cols>", "<row>", "</row>", "<c:x/>", "tail <c", "<", "<c r='2' t=''>\n</c>", "<si"]) for _ in range(rng.randint(0, 12)))
            with zipfile.ZipFile(io.BytesIO(pack({"s": xml}))) as z:
                got = list(parts.pieces(z, "s", containers.CELL, containers.CELL_OPENS))
            assert [m for _, m in got if m] == [m[0] for m in re.finditer(containers.CELL, xml)] and "".join(a + b for a, b in got) == xml


def test_a_sheet_of_many_cells_in_bounded_memory(tmp_path):
    n = 1_000_000
    with zipfile.ZipFile(tmp_path / "big.xlsx", "w", zipfile.ZIP_DEFLATED) as z, z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
        f.write(b"<worksheet><sheetData>")
        for i in range(n // 1000):
            f.write(b"<row>" + b"".join(b'<c r="%s%d" t="str"><v>text %d</v></c>' % (b"A", k, k) for k in range(i * 1000, i * 1000 + 1000)) + b"</row>")
        f.write(b"</sheetData></worksheet>")
    before, count = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, 0
    with parts.open_container(str(tmp_path / "big.xlsx")) as z:
        for _, cell in parts.pieces(z, "xl/worksheets/sheet1.xml", containers.CELL, containers.CELL_OPENS):
            count += bool(cell)
    assert count == n and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 40_000  # KB; the sheet has 45 MB


def test_cells_of_long_sheets_keep_their_numbers(spark, tmp_path):
    n = 25_000
    sheet = "<sheetData>" + "".join(f'<c r="A{i + 1}" t="s"><v>{i}</v></c>' if i % 2 else f'<c r="A{i + 1}" s="3" t="inlineStr"><is><t>a&amp;{i}</t></is></c>' for i in range(n)) + "</sheetData>"
    shared = "<sst>" + "".join(f"<si><t>s{i}</t></si>" for i in range(n)) + "</sst>"
    path = tmp_path / "w.xlsx"
    path.write_bytes(pack({"xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": shared, "xl/worksheets/sheet2.xml": "<x/>"}))
    src = spark.createDataFrame([(7, str(path))], "doc_id long, path string")
    cells = containers.read_workbook_cells(src)
    got = {r.cell_idx: (r.row, r.value) for r in cells.collect()}
    assert got == {i: (i, f"s{i}" if i % 2 else f"a&{i}") for i in range(n)}
    changed = cells.withColumn("changed", F.col("cell_idx") % 1000 < 2).withColumn("value", F.concat(F.lit("<"), "value"))
    new = containers.repack_workbook(src, changed)
    again = {r.cell_idx: r.value for r in containers.read_workbook_cells(new.select("doc_id", "content")).collect()}
    assert again == {i: ("<" if i % 1000 < 2 else "") + v for i, (_, v) in got.items()}
    with zipfile.ZipFile(io.BytesIO(new.first().content)) as z:
        xml = z.read("xl/worksheets/sheet1.xml").decode()
        assert xml.startswith('<sheetData><c r="A1" s="3" t="inlineStr"><is><t xml:space="preserve">&lt;a&amp;0</t></is></c><c r="A2" t="inlineStr">') and z.read("xl/sharedStrings.xml").decode() == shared
    assert pa is not None
