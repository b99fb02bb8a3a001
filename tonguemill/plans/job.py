"""The folder job, end to end: scan, skip, segment by family, translate, reassemble, write, report."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonguemill.core.config import JobConfig
from tonguemill.operators import cells, delimited, html, layout, ooxml, plain, report, translation
from tonguemill.sources import containers, files, parts, sink

SEGMENT = ("doc_id", "part", "seg_idx", "text")


def _docx_of_text(text: DataFrame) -> DataFrame:
    """(doc_id, content) of new documents with a paragraph per line."""
    return containers.build_docx(layout.document_xml(plain.lines_to_paragraphs(text)))


def _rows(docs: DataFrame, present: set[str]) -> list[DataFrame]:
    """Documents, or their parts, with their texts in order (see translate_rows), by family. Nothing is shuffled."""
    content = F.col("content") if "content" in docs.columns else files.contents("path")
    of = lambda f: docs.where(F.col("family") == f)
    text = lambda f: files.decode_text(of(f).select("doc_id", content.alias("content"))).select("doc_id", "text")
    out = {}
    if "plain" in present:
        out["plain"] = plain.paragraph_rows(text("plain"))
    if "rtf" in present:
        out["rtf"] = plain.paragraph_rows(text("rtf").select("doc_id", plain.strip_rtf(F.col("text")).alias("text")))
    if "csv" in present:
        out["csv"] = delimited.csv_rows(text("csv"))
    if "html" in present:
        pages, slots = text("html"), html.has_slots(F.col("text"))
        out["html"] = html.html_rows(pages.where(slots), html_col="text")
        out["html_plain"] = plain.paragraph_rows(pages.where(~slots))
    for d in (ooxml.DOCX, ooxml.PPTX):
        if d.name in present:
            out[d.name] = ooxml.ooxml_rows(containers.read_ooxml_parts(_packed(docs, d.name), d.name), d)
    return [df.withColumn("family", F.lit(f)) for f, df in out.items()]


def _packed(docs: DataFrame, family: str) -> DataFrame:
    """Containers of a family; they are read by ranges where there is a path."""
    return docs.where(F.col("family") == family).select("doc_id", parts.source_column(docs))


def _documents(docs: DataFrame, rows: DataFrame, present: set[str]) -> list[DataFrame]:
    """(doc_id, content, error) of translated rows, by family."""
    of = lambda f: rows.where(F.col("family") == f)
    good = lambda df: df.select("doc_id", "content", F.lit(None).cast("string").alias("error"))
    utf8 = lambda f, c: good(of(f).select("doc_id", c.cast("binary").alias("content")))
    out = []
    if "plain" in present:
        out.append(utf8("plain", plain.join_paragraphs()))
    if "rtf" in present:
        out.append(good(_docx_of_text(of("rtf").select("doc_id", plain.join_paragraphs().alias("text")))))
    if "csv" in present:
        out.append(utf8("csv", delimited.join_cells()))
    if "html" in present:
        out += [utf8("html", html.join_slots()), utf8("html_plain", plain.join_paragraphs())]
    for d in (ooxml.DOCX, ooxml.PPTX):
        if d.name in present:
            out.append(containers.repack_ooxml(_packed(docs, d.name), of(d.name).select("doc_id", "part", ooxml.join_paragraphs(d).alias("xml"))))
    return out


def translate_table(docs: DataFrame, translator, config: JobConfig, save: Callable[[DataFrame, str], DataFrame], glyphs: DataFrame | None = None, page_sizes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, family, and content or path) to (outputs (doc_id, content), status (doc_id, ok, error)). What can't be read is an error of
    its own.

    Texts, pages and Office parts are translated in their rows, all families together; workbook cells and page layout as segments. Page-layout
    documents are taken from a table of glyphs; those without one, and those without text, are errors. A document with a failed batch
    has no output. Families that no document has cost nothing.
    """
    present = {r.family for r in docs.select("family").distinct().collect()}
    outputs, states = [docs.where(F.lit(False)).select("doc_id", F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("error"))], []
    if rows := _rows(docs, present):
        every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
        told = save(translation.translate_rows(every, translator, config), "translated")
        outputs += _documents(docs, told, present)
        states.append(translation.row_status(told))

    segs, paged = [], docs.where("family = 'layout'").select("doc_id")
    if "workbook" in present:
        book = containers.read_workbook_cells(_packed(docs, "workbook"))
        in_book = cells.cell_segments(book)
        segs.append(in_book.select(*SEGMENT))
    paras = pages = None
    if glyphs is not None and "layout" in present:
        lines = layout.assemble_lines(layout.cluster_lines(glyphs.join(paged, "doc_id", "left_semi")))
        paras, pages = layout.stitch_pages(layout.paragraph_style(layout.paragraph_groups(lines), page_sizes), page_sizes)
        paras = save(paras, "paragraphs")
        segs.append(paras.select("doc_id", F.lit("").alias("part"), F.col("para_idx").alias("seg_idx"), "text"))
    if segs:
        done, answers = translation.translate_segments(save(reduce(DataFrame.unionByName, segs), "segments"), translator, config)
        done, answers = save(done.select(*SEGMENT), "translated_segments"), save(answers, "answers")
        states.append(translation.document_status(answers))
        if "workbook" in present:
            new = in_book.drop("text").join(done, ["doc_id", "part", "seg_idx"])
            outputs.append(containers.repack_workbook(_packed(docs, "workbook"), cells.assemble_cells(book, new)))
        if paras is not None:
            retold = paras.drop("text").join(done.select("doc_id", F.col("seg_idx").alias("para_idx"), "text"), ["doc_id", "para_idx"])
            outputs.append(containers.build_docx(layout.document_xml(retold, pages)).withColumn("error", F.lit(None).cast("string")))

    made = save(reduce(DataFrame.unionByName, outputs), "made")
    broken = made.where("error is not null").select("doc_id", F.lit(False).alias("ok"), "error")
    empty = paged.join(paras.where("text <> ''").select("doc_id"), "doc_id", "left_anti") if paras is not None else paged
    empty = empty.select("doc_id", F.lit(False).alias("ok"), F.lit(layout.NO_TEXT).alias("error"))
    status = reduce(DataFrame.unionByName, [s.select("doc_id", "ok", "error") for s in states], broken.where(F.lit(False))).join(broken, "doc_id", "left_anti").unionByName(broken)
    status = save(status.join(empty, "doc_id", "left_anti").unionByName(empty), "status")
    return made.drop("error").join(status.where("not ok").select("doc_id"), "doc_id", "left_anti"), status


def run_job(spark: SparkSession, config: JobConfig, translator, save: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Translates what the folder holds and returns results (name, dest, ok, skipped, error). Originals are never touched."""
    found = files.scan_documents(spark, config.in_dir, config.out_dir)
    existing = files.list_outputs(spark, config.out_dir)
    manifest = save(files.build_manifest(found, existing, config.out_dir), "manifest")
    todo, skipped = files.skip_existing(manifest, existing, config.skip_existing)
    docs = todo.select(F.col("path").alias("doc_id"), "path", "family")
    outputs, status = translate_table(docs, translator, config, save)
    outputs = save(outputs, "outputs")
    named = todo.select(F.col("path").alias("doc_id"), "name", "dest").join(status, "doc_id", "left").withColumn("ok", F.coalesce("ok", F.lit(True)))
    # of documents with one destination, the one that comes first or last in order keeps it
    winners = files.resolve_dest_collisions(named.select("doc_id", "name", "dest", "ok"), config.skip_existing)
    written = sink.write_documents(outputs.join(winners.select("doc_id", "dest"), "doc_id"), config.out_dir)
    losers = named.where("ok").join(winners.select("doc_id"), "doc_id", "left_anti")
    done = named.where("ok").join(winners.select("doc_id"), "doc_id", "left_semi").join(written.select("dest"), "dest", "left_semi")
    if not config.skip_existing:
        done, losers = done.unionByName(losers), losers.where(F.lit(False))
    return report.job_results(skipped.select("name", "dest").unionByName(losers.select("name", "dest")), done, named.where("not ok"))
