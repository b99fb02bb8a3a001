import io
import zipfile

from pyspark.sql import functions as F

from tonguemill.operators import cells, layout, ooxml, plain, report, translation, translators
from tonguemill.sources import containers, files
from tonguemill.streaming.ingest import ingest_stream


def folder(root):
    for name in ["a.txt", "b.TXT", "_under.txt", ".hidden.txt", "x.bin", "sub/c.md", "Oversatt/d.txt", "_dir/e.csv", "ut/f.txt", "sub/å.html"]:
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("hei")
    return str(root)


def test_scan_and_manifest(spark, tmp_path):
    at = folder(tmp_path)
    manifest, error = files.scan_folder(spark, at, f"{at}/ut")
    assert error is None
    assert sorted(r.name for r in manifest.collect()) == ["_dir/e.csv", "_under.txt", "a.txt", "b.TXT", "sub/c.md", "sub/å.html"]
    (tmp_path / "ut" / "a.txt").write_text("x")
    assert sorted((r.name, bytes(r.content)) for r in files.scan_documents(spark, at).where("name like '%\\_%'").collect()) == [("_dir/e.csv", b"hei"), ("_under.txt", b"hei")]
    manifest, _ = files.scan_folder(spark, at, f"{at}/ut")
    assert [r.name for r in manifest.where("already_translated").collect()] == ["a.txt"]
    assert files.scan_folder(spark, f"{at}/none", at) == (None, "Inn-mappen finnes ikke.")
    todo, skipped = files.skip_existing(manifest, files.list_outputs(spark, f"{at}/ut"))
    assert (todo.count(), skipped.count()) == (5, 1) and files.skip_existing(manifest, manifest, False)[0].count() == 6


def test_order_and_uploads(spark):
    df = spark.createDataFrame([(x,) for x in ["zoo", "ære", "Alt", "b", "øre", "åre"]], "path string")
    assert [r.path for r in files.order_manifest(df).collect()] == ["Alt", "b", "zoo", "ære", "øre", "åre"]
    # a folder over many ranges, beside small ones; equal paths
    names = [f"/in/a/{x}{i * 7 % 400}" for i in range(400) for x in ("ø", "b")] + ["/in/b/x", "/in/b/y", "rot", "/in/b/x", None]
    many = files.order_manifest(spark.createDataFrame([(x, 1) for x in names], "path string, n int").repartition(7))
    got = [(r.path, r.rank) for r in many.collect()]
    assert [r for p, r in got if p and "/a/" in p] == list(range(1, 801)) and [r for p, r in got if p and "/b/" in p] == [1, 2, 3]
    assert len(got) == len(names) and [p for p, _ in got if p and "/a/" in p][400] == "/in/a/ø0" and ("rot", 1) in got
    assert many.columns == ["path", "n", "rank"]
    up = spark.createDataFrame([("a.b.PDF", b"x"), ("y.zip", b"")], "name string, content binary")
    assert [(r.out_name, r.status) for r in files.translate_files(up).orderBy("name").collect()] == [("a.b.docx", "ok"), (None, "error")]


def test_decode(spark):
    df = spark.createDataFrame([(bytearray(b"\xef\xbb\xbfa\xff"),)], "content binary")
    assert files.decode_text(df).first().text == "﻿a�" and files.decode_text(df, csv=True).first().text == "a�"


def pack(parts):
    to = io.BytesIO()
    with zipfile.ZipFile(to, "w") as z:
        for n, x in parts.items():
            z.writestr(n, x)
    return to.getvalue()


def test_docx_whole(spark):
    body = '<w:document><w:p><w:r><w:t>kort</w:t></w:r><w:r><w:rPr/><w:t>mye &amp; langt</w:t><w:br/><w:t>x</w:t></w:r></w:p><w:p/><w:p><w:pPr/></w:p></w:document>'
    src = spark.createDataFrame([(1, pack({"word/document.xml": body, "word/media/i.png": "raw", "word/styles.xml": "<s/>"})), (2, b"broken")], "doc_id long, content binary")
    parts = containers.read_ooxml_parts(src, "docx")
    assert [(r.doc_id, r.part) for r in parts.collect()] == [(1, "word/document.xml")]
    done, _ = translation.translate_segments(ooxml.ooxml_segments(parts, ooxml.DOCX), translators.pseudo)
    new = {r.doc_id: r for r in containers.repack_ooxml(src, ooxml.rewrite_parts(parts, done, ooxml.DOCX)).collect()}
    assert new[2].content is None and new[2].error.startswith("Filen kan ikke leses") and new[1].error is None
    with zipfile.ZipFile(io.BytesIO(new[1].content)) as z:
        assert z.read("word/media/i.png") == b"raw"
        xml = z.read("word/document.xml").decode()
    s = ' xml:space="preserve"'
    assert xml == f"<w:document><w:p><w:r><w:t{s}></w:t></w:r><w:r><w:rPr/><w:t{s}>kurtmyi &amp; lengt</w:t><w:br/><w:t{s}>x</w:t><w:br/><w:t{s}></w:t></w:r></w:p><w:p/><w:p><w:pPr/></w:p></w:document>"


def test_workbook(spark):
    sheet = '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>5</v></c><c r="AA1" t="s"><v>1</v></c><c r="C1" t="str"><f>A1</f><v>boks</v></c><c r="D1" t="inlineStr"><is><t>inne</t></is></c><c r="E1" s="3"/></row></sheetData></worksheet>'
    shared = "<sst><si><t>eske &amp; lokk</t></si><si><r><t>NOK </t></r><r><t>5</t></r></si></sst>"
    src = spark.createDataFrame([(1, pack({"xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": shared}))], "doc_id long, content binary")
    got = containers.read_workbook_cells(src)
    assert [(r.row, r.col, r.type, r.formula, r.value) for r in got.orderBy("cell_idx").collect()] == [(0, 0, "s", None, "eske & lokk"), (0, 1, "n", None, "5"), (0, 26, "s", None, "NOK 5"), (0, 2, "str", "A1", "boks"), (0, 3, "s", None, "inne")]
    done, _ = translation.translate_segments(cells.cell_segments(got), translators.pseudo)
    new = containers.repack_workbook(src, cells.assemble_cells(got, done))
    again = containers.read_workbook_cells(new)
    assert [r.value for r in again.orderBy("cell_idx").collect()] == ["iski & lukk", "5", "NOK 5", "boks", "onni"]


def test_layout_edges(spark):
    raw = spark.createDataFrame([(1, 0, 0, "", [11.0, 0.0, 0.0, 11.0, 0.0, 0.0], 1.0, None), (1, 0, 1, "b", [0.0, 0.0, 0.0, 12.0, 60.0, 700.0], None, "X-Bold"), (1, 0, 2, "a", [11.0, 0.0, 0.0, 11.0, 50.0, 701.0], 4.0, "X")], "doc_id long, page int, item_idx int, str string, transform array<double>, width double, font_name string")
    lines = layout.assemble_lines(layout.cluster_lines(layout.normalize_glyphs(raw))).collect()
    assert [(r.text, r.font_size, r.bold, r.font_name) for r in lines] == [("a b", 12.0, True, "X")]
    none = spark.createDataFrame([(1, " "), (2, "x")], "doc_id long, text string")
    assert {r.doc_id: r.status for r in layout.reject_empty_layout(none).collect()} == {1: "error", 2: "ok"}


def test_report(spark):
    got = report.overall_progress(spark.createDataFrame([("a", 1, 2), ("b", 0, 0)], "name string, done int, total int")).orderBy("name").collect()
    assert [r.percent for r in got] == [25, 50]


def test_stream_sees_each_document_once(spark, tmp_path):
    src, seen = tmp_path / "in", []
    src.mkdir()

    def handle(df, n):
        seen.extend(r.name for r in df.select("name").collect())

    for names in (["a.txt", "x.bin"], ["b.md"]):
        for n in names:
            (src / n).write_text("x")
        ingest_stream(spark, str(src), str(tmp_path / "ck"), handle).awaitTermination()
    assert seen == ["a.txt", "b.md"]
    plain.lines_to_paragraphs(spark.createDataFrame([(1, "a\r\nb")], "doc_id long, text string")).count()
    assert F is not None


def test_folder_job(spark, tmp_path):
    from tonguemill.core.config import JobConfig
    from tonguemill.plans.job import run_job

    src, out = tmp_path / "in", tmp_path / "in" / "oversatt"
    src.mkdir()
    (src / "a.txt").write_text("en bok\n\nto\n")
    (src / "b.csv").write_text("navn,1\nola,2")
    (src / "c.htm").write_text("<p>hallo der</p>")
    (src / "d.html").write_text("ingen")
    (src / "e.rtf").write_text("{\\rtf1{\\fonttbl{\\f0 Arial;}}\\f0 hei\nsann}")
    (src / "f.pdf").write_bytes(b"%PDF")
    (src / "g.docx").write_bytes(pack({"word/document.xml": "<w:p><w:r><w:t>tekst</w:t></w:r></w:p>"}))
    (src / "empty.txt").write_text("")
    (src / "bad.docx").write_bytes(b"not a container")
    (src / "cut.pptx").write_bytes(pack({"ppt/slides/slide1.xml": "<a:p>" + "x" * 500 + "</a:p>"})[:-60])
    (src / "none.xlsx").write_bytes(b"")
    twisted = bytearray(pack({"word/document.xml": "<w:p><w:r><w:t>tekst</w:t></w:r></w:p>"}))
    twisted[50:60] = b"0123456789"  # its checksum tells
    (src / "sum.docx").write_bytes(twisted)
    (src / "s.pptx").write_bytes(pack({"ppt/slides/slide1.xml": "<a:p><a:r><a:t>lysark</a:t></a:r></a:p>", "ppt/media/x.png": "raw"}))
    (src / "h.xlsx").write_bytes(pack({"xl/worksheets/sheet1.xml": '<c r="A1" t="inlineStr"><is><t>celle</t></is></c>'}))
    n = iter(range(100))

    def save(df, label):
        at = f"{tmp_path}/scratch/{label}{next(n)}"
        df.write.parquet(at)
        return spark.read.parquet(at)

    config = JobConfig(str(src), str(out))
    results = {r.name: (r.ok, r.skipped, r.error) for r in run_job(spark, config, translators.pseudo, save).collect()}
    assert results.pop("f.pdf") == (False, False, layout.NO_TEXT)
    for name in ("bad.docx", "cut.pptx", "none.xlsx", "sum.docx"):
        ok, skipped, error = results.pop(name)
        assert not ok and not skipped and error.startswith("Filen kan ikke leses"), name
        assert not (out / name).exists()
    assert set(results) == set("a.txt b.csv c.htm d.html e.rtf empty.txt g.docx h.xlsx s.pptx".split()) and set(results.values()) == {(True, False, None)}
    assert (out / "a.txt").read_text() == "in buk\n\ntu\n" and (out / "b.csv").read_text() == "nevn,1\nule,2\n"
    assert (out / "empty.txt").read_bytes() == b""
    assert (out / "c.html").read_text() == "<p>hellu dir</p>" and (out / "d.html").read_text() == "ongin"
    with zipfile.ZipFile(out / "e.docx") as z:
        assert "<w:t xml:space=\"preserve\">hio</w:t>" in z.read("word/document.xml").decode()
    with zipfile.ZipFile(out / "g.docx") as z:
        assert ">tikst<" in z.read("word/document.xml").decode()
    with zipfile.ZipFile(out / "h.xlsx") as z:
        assert ">cilli<" in z.read("xl/worksheets/sheet1.xml").decode()
    with zipfile.ZipFile(out / "s.pptx") as z:
        assert "<a:t>lyserk</a:t>" in z.read("ppt/slides/slide1.xml").decode() and z.read("ppt/media/x.png") == b"raw"
    again = run_job(spark, config, translators.pseudo, save)
    assert report.job_summary(again).first().asDict() == {"translated": 0, "skipped": 9, "failed": 5}
