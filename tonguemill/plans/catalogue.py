"""Queries of the translation operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonguemill.functions import scalars
from tonguemill.operators import cells, delimited, html, layout, ooxml, plain, report, translation, translators
from tonguemill.plans import fixtures as fx
from tonguemill.sources import containers, files

TURN = "translate({}, 'aeiou', 'eioua')"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH RECURSIVE {fx.TEXT_DOCS}, {fx.BATCHES}, n AS (SELECT doc_id, count(*) AS n_segments, max(batch_id) + 1 AS n_batches FROM b GROUP BY doc_id) SELECT doc_id, lang, n_segments, CAST(n_batches AS BIGINT) AS n_batches, {TURN.format('norm')} AS translated FROM norm JOIN n USING (doc_id)")
def translate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = translation.translate_rows(plain.paragraph_rows(fx.text_docs(spark, sf_dir), keep=("lang",)), translators.pseudo)
    # null, empty and blank texts have nothing to send and come back as they are
    return rows.select("doc_id", "lang", F.col("n_texts").cast("long").alias("n_segments"), F.col("n_batches").cast("long").alias("n_batches"), plain.join_paragraphs().alias("translated"))


@query(f"WITH {fx.TEXT_DOCS} SELECT doc_id, CAST(seg_idx AS INTEGER) AS seg_idx, text, sep_after FROM segs")
def paragraph_segments(spark, sf_dir):
    return plain.paragraph_segments(fx.text_docs(spark, sf_dir)).select("doc_id", "seg_idx", "text", "sep_after")


@query(f"WITH RECURSIVE {fx.LINE_SEGS}, {fx.BATCHES} SELECT doc_id, batch_id, count(*) AS n_items, CAST(min(seg_idx) AS INTEGER) AS first_seg, CAST(max(seg_idx) AS INTEGER) AS last_seg FROM b GROUP BY doc_id, batch_id")
def assign_batches(spark, sf_dir):
    work, _ = translation.split_blank(fx.line_segments(spark, sf_dir))
    return translation.assign_batches(work).groupBy("doc_id", "batch_id").agg(F.count("*").alias("n_items"), F.min("seg_idx").alias("first_seg"), F.max("seg_idx").alias("last_seg"))


@query(f"WITH RECURSIVE {fx.LINE_SEGS}, {fx.BATCHES}, s AS (SELECT doc_id, batch_id, count(*) AS size FROM b GROUP BY doc_id, batch_id) SELECT doc_id, batch_id, size, CAST(sum(size) OVER (PARTITION BY doc_id ORDER BY batch_id) AS BIGINT) AS done, CAST(sum(size) OVER (PARTITION BY doc_id) AS BIGINT) AS total FROM s")
def batch_progress(spark, sf_dir):
    work, _ = translation.split_blank(fx.line_segments(spark, sf_dir))
    return translation.batch_progress(translation.assign_batches(work)).drop("part")


_LINES = " || chr(10) || ".join("'" + x.replace("{label}", "norsk nynorsk").replace("{n}", "' || count(*) || '") + "'" for x in translation.INSTRUCTIONS)


@query(f"WITH RECURSIVE {fx.TURN_SEGS}, {fx.BATCHES} SELECT doc_id, batch_id, CAST(count(*) AS INTEGER) AS n_items, {_LINES} || chr(10) || chr(10) || '[' || chr(10) || '  ' || string_agg(CAST(to_json(text) AS VARCHAR), ',' || chr(10) || '  ' ORDER BY seg_idx) || chr(10) || ']' AS prompt FROM b JOIN segs USING (doc_id, seg_idx) GROUP BY doc_id, batch_id")
def build_prompts(spark, sf_dir):
    work, _ = translation.split_blank(fx.turn_segments(spark, sf_dir))
    batches = translation.gather_batches(work, translation.assign_batches(work))
    return translation.guard_prompt(translation.build_prompt(batches, "nynorsk")).where("status = 'ok'").select("doc_id", "batch_id", F.size("items").alias("n_items"), "prompt")


_SLOTS = """chunks AS (SELECT {id} AS doc_id, i AS chunk_idx, ps[i + 1] AS chunk, len(ps) AS n FROM (SELECT *, unnest(range(len(ps))) AS i FROM (SELECT *, string_split(html, '<') AS ps FROM {t}))),
slots AS (SELECT *, instr(chunk, '>') AS pos, substr(chunk, instr(chunk, '>') + 1) AS raw FROM chunks),
told AS (SELECT *, pos > 0 AND chunk_idx < n - 1 AND length(raw) >= 3 AND regexp_matches(raw, '[A-Za-zÀ-ÿ]') AS slot FROM slots)"""


@query(f"WITH {_SLOTS.format(id='page_id', t='pages')} SELECT doc_id AS page_id, CAST(chunk_idx AS INTEGER) AS seg_idx, raw AS text FROM told WHERE slot")
def html_text_segments(spark, sf_dir):
    return html.html_text_segments(fx.table(spark, sf_dir, "pages"), id_col="page_id").select(F.col("doc_id").alias("page_id"), "seg_idx", "text")


@query(f"WITH {_SLOTS.format(id='page_id', t='pages')} SELECT doc_id AS page_id, string_agg(CASE WHEN slot THEN left(chunk, pos) || {TURN.format('raw')} ELSE chunk END, '<' ORDER BY chunk_idx) AS html FROM told GROUP BY doc_id")
def translate_html(spark, sf_dir):
    rows = translation.translate_rows(html.html_rows(fx.table(spark, sf_dir, "pages"), id_col="page_id"), translators.pseudo)
    return rows.select(F.col("doc_id").alias("page_id"), html.join_slots().alias("html"))


@query(f"""WITH mixed AS (SELECT page_id, CASE WHEN page_id % 25 = 0 THEN regexp_replace(html, '<[^>]*>', chr(10) || chr(10), 'g') ELSE html END AS html FROM pages), {_SLOTS.format(id='page_id', t='mixed')},
plain AS (SELECT page_id AS doc_id, html, rtrim(html, chr(10)) AS core FROM mixed WHERE page_id NOT IN (SELECT doc_id FROM told WHERE slot)),
cut AS (SELECT doc_id, string_split_regex(core, '\\n{{2,}}') AS ps, list_concat(regexp_extract_all(core, '\\n{{2,}}'), [substr(html, length(core) + 1)]) AS seps FROM plain)
SELECT doc_id AS page_id, CAST(chunk_idx AS INTEGER) AS seg_idx, 'slot' AS kind, raw AS text, '' AS sep_after FROM told WHERE slot
UNION ALL SELECT doc_id, CAST(i AS INTEGER), 'paragraph', ps[i + 1], seps[i + 1] FROM (SELECT *, unnest(range(len(ps))) AS i FROM cut)""")
def html_fallback(spark, sf_dir):
    bare = F.regexp_replace("html", "<[^>]*>", "\n\n")
    pages = fx.table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 25 == 0, bare).otherwise(F.col("html")).alias("html"))
    return html.html_segments(pages, id_col="page_id").select(F.col("doc_id").alias("page_id"), "seg_idx", "kind", "text", "sep_after")


@query(f"WITH {fx.CSV_DOCS} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY row, col) - 1 AS INTEGER) AS seg_idx, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, quoted, raw AS text FROM csv_told WHERE eligible")
def csv_cell_segments(spark, sf_dir):
    return delimited.csv_cell_segments(fx.csv_docs(spark, sf_dir)).select("doc_id", "seg_idx", "row", "col", "quoted", "text")


@query(f"""WITH {fx.CSV_DOCS}, o AS (SELECT *, CASE WHEN NOT eligible THEN cell WHEN quoted OR regexp_matches(raw, '[",\\n]') THEN '"' || replace({TURN.format('raw')}, '"', '""') || '"' ELSE {TURN.format('raw')} END AS o FROM csv_told),
l AS (SELECT doc_id, row, string_agg(o, ',' ORDER BY col) AS line, bool_or(eligible) AS e FROM o GROUP BY doc_id, row), d AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY row) AS text, bool_or(e) AS e FROM l GROUP BY doc_id)
SELECT doc_id, CASE WHEN e THEN d.text || CASE WHEN ends_with(d.text, chr(10)) THEN '' ELSE chr(10) END ELSE csv_docs.text END AS text FROM d JOIN csv_docs USING (doc_id)""")
def translate_csv(spark, sf_dir):
    rows = translation.translate_rows(delimited.csv_rows(fx.csv_docs(spark, sf_dir)), translators.pseudo)
    return rows.select("doc_id", delimited.join_cells().alias("text"))


@query(f"WITH {fx.RTF_DOCS} SELECT doc_id, text FROM stripped")
def strip_rtf(spark, sf_dir):
    return fx.rtf_docs(spark, sf_dir).select("doc_id", plain.strip_rtf(F.col("text")).alias("text"))


@query(f"WITH {fx.RTF_DOCS}, p AS (SELECT doc_id, string_split({TURN.format('text')}, chr(10)) AS ls FROM stripped) SELECT doc_id, CAST(i AS INTEGER) AS para_idx, ls[i + 1] AS text FROM (SELECT *, unnest(range(len(ls))) AS i FROM p)")
def rtf_paragraphs(spark, sf_dir):
    text = fx.rtf_docs(spark, sf_dir).select("doc_id", plain.strip_rtf(F.col("text")).alias("text"))
    rows = translation.translate_rows(plain.paragraph_rows(text), translators.pseudo)
    return plain.lines_to_paragraphs(rows.select("doc_id", plain.join_paragraphs().alias("text")))


@query(f"WITH {fx.CELLS} SELECT doc_id, row, col, value FROM text_cells")
def workbook_text_cells(spark, sf_dir):
    return cells.workbook_text_cells(fx.cells(spark, sf_dir)).select("doc_id", "row", "col", "value")


@query(f"WITH {fx.CELLS} SELECT c.doc_id, c.row, c.col, CASE WHEN t.value IS NULL THEN c.type ELSE 's' END AS type, coalesce({TURN.format('t.value')}, c.value) AS value, t.value IS NOT NULL AS changed FROM cells c LEFT JOIN text_cells t USING (doc_id, sheet, row, col)")
def translate_cells(spark, sf_dir):
    src = fx.cells(spark, sf_dir)
    translated, _ = translation.translate_segments(cells.cell_segments(src), translators.pseudo)
    return cells.assemble_cells(src, translated).select("doc_id", "row", "col", "type", "value", "changed")


@query(f"WITH {fx.FILES} SELECT doc_id, ext, family, out_ext, CASE WHEN family IS NULL THEN 'error' ELSE 'ok' END AS status, CASE WHEN family IS NULL THEN 'Filtypen ' || ext || ' støttes ikke.' END AS error FROM routed")
def route_formats(spark, sf_dir):
    return files.route_formats(fx.files(spark, sf_dir)).select("doc_id", "ext", "family", "out_ext", "status", "error")


@query(f"WITH {fx.FILES} SELECT doc_id, name, ext, dest FROM routed")
def with_dest(spark, sf_dir):
    told = fx.files(spark, sf_dir).withColumn("ext", scalars.ext_of(F.col("name")))
    return files.with_dest(files.route_formats(told), "/ut").select("doc_id", "name", "ext", "dest")


def _manifest(spark, sf_dir):
    routed = files.with_dest(files.route_formats(fx.files(spark, sf_dir)), "/ut")
    return routed, routed.where("doc_id % 5 = 0 and dest is not null").select("dest").distinct()


@query(f"WITH {fx.FILES} SELECT name, ext, length AS bytes, dest, existing.dest IS NOT NULL AS already_translated FROM routed LEFT JOIN existing USING (dest)")
def build_manifest(spark, sf_dir):
    _, existing = _manifest(spark, sf_dir)
    return files.build_manifest(fx.files(spark, sf_dir), existing, "/ut").select("name", "ext", "bytes", "dest", "already_translated")


@query(f"WITH {fx.FILES} SELECT doc_id, dest IN (SELECT dest FROM existing) AS skipped FROM routed WHERE dest IS NOT NULL")
def skip_existing(spark, sf_dir):
    routed, existing = _manifest(spark, sf_dir)
    todo, skipped = files.skip_existing(routed.where("dest is not null"), existing)
    return todo.select("doc_id", F.lit(False).alias("skipped")).union(skipped.select("doc_id", F.lit(True)))


@query(f"WITH {fx.FILES} SELECT dest, min(name) AS first_name, max(name) AS last_name FROM routed WHERE dest IS NOT NULL AND doc_id % 13 <> 0 GROUP BY dest")
def dest_collisions(spark, sf_dir):
    routed, _ = _manifest(spark, sf_dir)
    results = routed.where("dest is not null").select("name", "dest", (F.col("doc_id") % 13 != 0).alias("ok"))
    first = files.resolve_dest_collisions(results, skip=True).select("dest", F.col("name").alias("first_name"))
    return first.join(files.resolve_dest_collisions(results, skip=False).select("dest", F.col("name").alias("last_name")), "dest")


@query(f"WITH {fx.FILES} SELECT count(*) AS files, count(*) FILTER (dest IN (SELECT dest FROM existing)) AS translated FROM routed")
def inbox_stats(spark, sf_dir):
    _, existing = _manifest(spark, sf_dir)
    return report.inbox_stats(files.build_manifest(fx.files(spark, sf_dir), existing, "/ut"))


@query(f"WITH n AS (SELECT doc_id, {list(fx.NAMES)}[doc_id % {len(fx.NAMES)} + 1] AS name, {list(fx.NAMES.values())}[doc_id % {len(fx.NAMES)} + 1] AS k, doc_id // {len(fx.NAMES)} AS f FROM documents) SELECT doc_id, '/in/' || f || '/' || name AS path, CAST(row_number() OVER (PARTITION BY f ORDER BY k) AS INTEGER) AS rank FROM n")
def order_manifest(spark, sf_dir):
    return files.order_manifest(fx.norwegian_files(spark, sf_dir)).select("doc_id", "path", "rank")


@query(f"WITH {fx.OOXML} SELECT doc_id, para_idx, text FROM told")
def ooxml_paragraphs(spark, sf_dir):
    return ooxml.ooxml_paragraphs(fx.ooxml_parts(spark, sf_dir), ooxml.DOCX).select("doc_id", "para_idx", "text")


@query(f"WITH {fx.OOXML} SELECT doc_id, para_idx, CAST(2 * (best - 1) AS INTEGER) AS run_idx, rs[best] AS text FROM told")
def dominant_run(spark, sf_dir):
    paras = ooxml.ooxml_paragraphs(fx.ooxml_parts(spark, sf_dir), ooxml.DOCX)
    return ooxml.dominant_run(ooxml.paragraph_runs(paras, ooxml.DOCX)).select("doc_id", "para_idx", "run_idx", "text")


_OLD = "list_transform(rs, lambda r: '<{p}:r><{p}:rPr b=\"1\"/><{p}:t>' || " + fx._ESC.format(x="r") + " || '</{p}:t></{p}:r>')"
_W = "'<w:r><w:rPr b=\"1\"/><w:t xml:space=\"preserve\">' || CASE WHEN i = best THEN " + fx._ESC.format(x=TURN.format("text")) + " ELSE '' END || '</w:t></w:r>'"
_A = "'<a:r><a:rPr b=\"1\"/><a:t>' || CASE WHEN i = best THEN replace(" + fx._ESC.format(x=TURN.format("text")) + ", chr(9), '</a:t></a:r><a:br/><a:r><a:rPr b=\"1\"/><a:t>') ELSE '' END || '</a:t></a:r>'"
_REWRITE = """WITH {o}, r AS (SELECT doc_id, para_idx, '<{p}:p><{p}:pPr/>' || array_to_string(CASE WHEN regexp_matches(text, '[^\\s\\p{{Z}}]') THEN list_transform(rs, lambda x, i: {new}) ELSE {old} END, '<{p}:r><{p}:tab/></{p}:r>') || '</{p}:p>' AS xml FROM told)
SELECT doc_id, '<x>' || string_agg(xml, '' ORDER BY para_idx) || '</x>' AS xml FROM r GROUP BY doc_id"""


@query(_REWRITE.format(o=fx.OOXML, p="w", new=_W, old=_OLD.format(p="w")))
def rewrite_docx(spark, sf_dir):
    rows = translation.translate_rows(ooxml.ooxml_rows(fx.ooxml_parts(spark, sf_dir), ooxml.DOCX), translators.pseudo)
    return rows.select("doc_id", ooxml.join_paragraphs(ooxml.DOCX).alias("xml"))


@query(_REWRITE.format(o=fx.OOXML, p="a", new=_A, old=_OLD.format(p="a")))
def rewrite_pptx(spark, sf_dir):
    rows = translation.translate_rows(ooxml.ooxml_rows(fx.ooxml_parts(spark, sf_dir, "a"), ooxml.PPTX), translators.pseudo)
    return rows.withColumn("texts", F.transform("texts", lambda t: F.translate(t, "\t", "\n"))).select("doc_id", ooxml.join_paragraphs(ooxml.PPTX).alias("xml"))


@query("""SELECT page_id, list_transform(regexp_extract_all(html, '(?s)<a(?:\\s[^>]*)?>(.*?)</a>', 1), lambda x: replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&')) AS texts,
       array_to_string(list_transform(string_split(html, '<h1>'), lambda x, i: CASE WHEN i = 2 THEN ' xml:space="preserve">A &amp; B</h1>' || substr(x, instr(x, '</h1>') + 5) ELSE x END), '<h1') AS html FROM pages""")
def tagged_text(spark, sf_dir):
    pages = fx.table(spark, sf_dir, "pages")
    return pages.select("page_id", scalars.extract_tagged_text(F.col("html"), "a").alias("texts"), scalars.replace_tagged_text(F.col("html"), "h1", F.array(F.lit("A & B"))).alias("html"))


def _clustered(spark, sf_dir):
    return layout.cluster_lines(layout.normalize_glyphs(fx.glyph_items(spark, sf_dir)), gathered=True)


def _lines(spark, sf_dir):
    return layout.assemble_lines(_clustered(spark, sf_dir))


@query(f"WITH {fx.GLYPHS} SELECT doc_id, page, line_idx, round(any_value(lines1.y), 6) AS y, CAST(count(*) AS INTEGER) AS n_items FROM lines1 JOIN glyphs USING (doc_id, page, l) GROUP BY doc_id, page, line_idx")
def cluster_lines(spark, sf_dir):
    return _clustered(spark, sf_dir).select("doc_id", "page", "line_idx", F.round("y", 6).alias("y"), "n_items")


@query(f"WITH {fx.GLYPHS} SELECT doc_id, page, line_idx, text, font_size, font_name, bold, italic, x, x_end FROM lines1")
def line_style(spark, sf_dir):
    return _lines(spark, sf_dir).drop("y")


@query(f"WITH {fx.GLYPHS} SELECT doc_id, page, line_idx, para_idx, starts, round(gap, 6) AS gap FROM grouped")
def paragraph_groups(spark, sf_dir):
    return layout.paragraph_groups(_lines(spark, sf_dir)).select("doc_id", "page", "line_idx", "para_idx", "starts", F.round("gap", 6).alias("gap"))


def _styled(spark, sf_dir):
    sizes = fx.page_sizes(spark, sf_dir)
    return layout.paragraph_style(layout.paragraph_groups(_lines(spark, sf_dir)), sizes), sizes


@query(f"WITH {fx.GLYPHS} SELECT doc_id, page, para_idx, text, font_size, font_name, bold, italic, align, space_before, space_after, line_twips FROM styled")
def paragraph_style(spark, sf_dir):
    return _styled(spark, sf_dir)[0].drop("left")


_STITCH = """, pages0 AS (SELECT DISTINCT doc_id, page FROM glyphs), firsts AS (SELECT doc_id, min(page) AS f FROM pages0 GROUP BY doc_id),
together AS (SELECT doc_id, page, para_idx + 1 AS k, text, font_size, font_name, bold, italic, align, space_before, space_after, line_twips FROM styled
             UNION ALL SELECT doc_id, page, 0, '', NULL, NULL, NULL, NULL, NULL, 240, NULL, NULL FROM pages0 JOIN firsts USING (doc_id) WHERE page > f),
stitched AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, k) - 1 AS INTEGER) AS p FROM together)"""


@query(f"WITH {fx.GLYPHS}{_STITCH} SELECT doc_id, p AS para_idx, text, space_before, margin FROM stitched JOIN (SELECT doc_id, CAST(least(greatest(floor(min(x) + 0.5), 36), 90) AS INTEGER) AS margin FROM lines1 GROUP BY doc_id) USING (doc_id)")
def stitch_pages(spark, sf_dir):
    paras, _ = layout.stitch_pages(*_styled(spark, sf_dir))
    return paras.select("doc_id", "para_idx", "text", "space_before", "margin")


_FONT = "CASE WHEN font_name LIKE '%Times%' THEN 'Times New Roman' WHEN font_name IS NULL THEN 'Calibri' ELSE 'Arial' END"
_PROPS = "'<w:rPr><w:rFonts w:ascii=\"' || f || '\" w:hAnsi=\"' || f || '\" w:cs=\"' || f || '\"/><w:sz w:val=\"' || sz || '\"/><w:szCs w:val=\"' || sz || '\"/>' || CASE WHEN bold THEN '<w:b/><w:bCs/>' ELSE '' END || CASE WHEN italic THEN '<w:i/><w:iCs/>' ELSE '' END || '</w:rPr>'"


@query(f"""WITH {fx.GLYPHS}{_STITCH}, q AS (SELECT *, {_FONT} AS f, CAST(coalesce(2 * font_size, 22) AS INTEGER) AS sz FROM stitched), pr AS (SELECT *, {_PROPS} AS props FROM q)
SELECT doc_id, p AS para_idx, '<w:p><w:pPr>' || CASE WHEN align <> 'left' THEN '<w:jc w:val="' || align || '"/>' ELSE '' END || '<w:spacing w:before="' || space_before || '" w:after="' || coalesce(space_after, 0) || '" w:line="' || coalesce(line_twips, 240) || '" w:lineRule="auto"/></w:pPr>' ||
  CASE WHEN text = '' THEN '' ELSE '<w:r>' || props || '<w:t xml:space="preserve">' || replace({fx._ESC.format(x='text')}, chr(10), '</w:t></w:r><w:r>' || props || '<w:br/></w:r><w:r>' || props || '<w:t xml:space="preserve">') || '</w:t></w:r>' END || '</w:p>' AS xml FROM pr""")
def paragraph_xml(spark, sf_dir):
    paras, _ = layout.stitch_pages(*_styled(spark, sf_dir))
    return layout.paragraph_xml(paras).select("doc_id", "para_idx", "xml")


@query("SELECT doc_id, CAST(i AS INTEGER) AS para_idx, ls[i + 1] AS text FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))")
def docx_round_trip(spark, sf_dir):
    paras = plain.lines_to_paragraphs(fx.table(spark, sf_dir, "documents"))
    made = containers.build_docx(layout.document_xml(paras))
    return ooxml.ooxml_paragraphs(containers.read_ooxml_parts(made, "docx"), ooxml.DOCX).select("doc_id", "para_idx", "text")


_SLIDES = f"WITH {fx.OOXML} SELECT doc_id, para_idx, CASE WHEN regexp_matches(text, '[^\\s\\p{{Z}}]') THEN {TURN.format('text')} ELSE text END AS text FROM told"


@query(_SLIDES)
def pptx_round_trip(spark, sf_dir):
    """Slides in containers, read, translated, packed again and read again; tabs stand in runs of their own and are left where they are."""
    made = containers.pack_parts(fx.ooxml_parts(spark, sf_dir, "a"))
    rows = translation.translate_rows(ooxml.ooxml_rows(containers.read_ooxml_parts(made, "pptx"), ooxml.PPTX), translators.pseudo)
    # the translation holds the tabs, so those between the runs go with their runs
    bare = F.replace(ooxml.join_paragraphs(ooxml.PPTX), F.lit("<a:r><a:tab/></a:r>"), F.lit(""))
    packed = containers.repack_ooxml(made, rows.select("doc_id", "part", bare.alias("xml")))
    return ooxml.ooxml_paragraphs(containers.read_ooxml_parts(packed, "pptx"), ooxml.PPTX).select("doc_id", "para_idx", "text")


@query("""WITH v AS (SELECT p_partkey // 50 AS doc_id, CAST(p_partkey % 50 AS INTEGER) AS row, p_name, p_type, CAST(p_size AS VARCHAR) AS size FROM part)
SELECT CAST(doc_id AS BIGINT) AS doc_id, row, unnest([0, 1, 2]) AS col, unnest(['s', 's', 'n']) AS type, unnest([translate(p_name, 'aeiou', 'eioua'), translate(p_type, 'aeiou', 'eioua'), size]) AS value FROM v""")
def workbook_round_trip(spark, sf_dir):
    """Workbooks with shared, inline and number cells, read, translated, packed again and read again."""
    made = containers.pack_parts(fx.workbook_parts(spark, sf_dir))
    book = containers.read_workbook_cells(made)
    done, _ = translation.translate_segments(cells.cell_segments(book), translators.pseudo)
    again = containers.read_workbook_cells(containers.repack_workbook(made, cells.assemble_cells(book, done)))
    return again.select("doc_id", "row", "col", "type", "value")


@query(f"WITH {fx.RESPONSES} SELECT doc_id, batch_id, CASE WHEN fault < 3 THEN CASE WHEN fault = 1 THEN '```json' || chr(10) || CAST(to_json(items) AS VARCHAR) || chr(10) || '```' ELSE CAST(to_json(items) AS VARCHAR) END ELSE '' END AS text FROM told")
def response_text(spark, sf_dir):
    return fx.responses(spark, sf_dir).select("doc_id", "batch_id", translation.response_text(F.col("body")).alias("text"))


@query(f"WITH {fx.RESPONSES} SELECT doc_id, batch_id, CASE WHEN fault > 2 THEN error END AS error FROM told")
def response_error(spark, sf_dir):
    return fx.responses(spark, sf_dir).select("doc_id", "batch_id", translation.response_error(F.col("body"), F.col("http_status")).alias("error"))


@query(f"WITH {fx.RESPONSES} SELECT doc_id, batch_id, CASE WHEN error IS NULL THEN items END AS translations, error FROM told")
def parse_translation_array(spark, sf_dir):
    return translation.read_responses(fx.responses(spark, sf_dir)).select("doc_id", "batch_id", "translations", "error")


def _answers(spark, sf_dir):
    first = translation.read_responses(fx.responses(spark, sf_dir)).select("doc_id", "part", "batch_id", "translations", "error")
    good = F.col("doc_id") % 2 == 0
    second = first.where("error is not null").select("doc_id", "part", "batch_id", F.when(good, F.array(F.lit("x"))).alias("translations"), F.when(~good, "again").alias("error"))
    return translation.retry_union(first, second)


@query(f"WITH {fx.RESPONSES} SELECT doc_id, batch_id, CASE WHEN error IS NULL THEN items WHEN doc_id % 2 = 0 THEN ['x'] END AS translations, CASE WHEN doc_id % 2 <> 0 THEN error END AS error FROM told")
def retry_union(spark, sf_dir):
    return _answers(spark, sf_dir).drop("part")


_STATUS = f"{fx.RESPONSES}, a AS (SELECT doc_id, batch_id, CASE WHEN doc_id % 2 <> 0 THEN error END AS error FROM told), s AS (SELECT doc_id, count(*) AS n_batches, bool_and(error IS NULL) AS ok, arg_min(error, batch_id) FILTER (error IS NOT NULL) AS error FROM a GROUP BY doc_id)"


@query(f"WITH {_STATUS} SELECT doc_id, n_batches, ok, error FROM s")
def document_status(spark, sf_dir):
    return translation.document_status(_answers(spark, sf_dir))


def _results(spark, sf_dir):
    status = translation.document_status(_answers(spark, sf_dir)).withColumn("name", F.concat(F.lit("c"), F.col("doc_id").cast("string"))).withColumn("dest", F.concat(F.lit("/ut/"), "name"))
    skip = F.col("doc_id") % 9 == 0
    return report.job_results(status.where(skip), status.where(~skip & F.col("ok")), status.where(~skip & ~F.col("ok")))


@query(f"WITH {_STATUS} SELECT 'c' || doc_id AS name, CASE WHEN doc_id % 9 = 0 OR ok THEN '/ut/c' || doc_id END AS dest, doc_id % 9 = 0 OR ok AS ok, doc_id % 9 = 0 AS skipped, CASE WHEN doc_id % 9 <> 0 THEN error END AS error FROM s")
def job_results(spark, sf_dir):
    return _results(spark, sf_dir)


@query(f"WITH {_STATUS} SELECT count(*) FILTER (doc_id % 9 <> 0 AND ok) AS translated, count(*) FILTER (doc_id % 9 = 0) AS skipped, count(*) FILTER (doc_id % 9 <> 0 AND NOT ok) AS failed FROM s")
def job_summary(spark, sf_dir):
    return report.job_summary(_results(spark, sf_dir))


_TOKENS = "regexp_extract_all({x}, 'https?://[^\\s<>\"]+|[\\w.+-]+@[\\w-]+\\.[\\w.-]+|[0-9]+(?:[.,:][0-9]+)*')"


@query(f"""WITH s AS (SELECT doc_id, replace(text, ', ', chr(9)) AS source FROM documents),
d AS (SELECT doc_id, source, CASE doc_id % 4 WHEN 0 THEN replace({TURN.format('source')}, chr(10), ' ') WHEN 1 THEN replace({TURN.format('source')}, chr(10), chr(10) || chr(10)) WHEN 2 THEN regexp_replace(replace({TURN.format('source')}, chr(9), ' '), '[0-7]', 'x', 'g') ELSE source END AS target FROM s),
n AS (SELECT doc_id, {', '.join(f"CAST(len(string_split(target, {m})) - len(string_split(source, {m})) AS INTEGER) AS d_{k}" for k, m in (("lines", "chr(10)"), ("gaps", "chr(10) || chr(10)"), ("tabs", "chr(9)")))},
  list_sort(list_distinct(list_filter({_TOKENS.format(x='source')}, lambda x: NOT list_contains({_TOKENS.format(x='target')}, x)))) AS lost FROM d)
SELECT *, d_lines = 0 AND d_gaps = 0 AND d_tabs = 0 AND len(lost) = 0 AS kept FROM n""")
def layout_check(spark, sf_dir):
    source = F.replace("text", F.lit(", "), F.lit("\t"))
    turned, by = translators.pseudo_text(source), F.col("doc_id") % 4
    target = F.when(by == 0, F.replace(turned, F.lit("\n"), F.lit(" "))).when(by == 1, F.replace(turned, F.lit("\n"), F.lit("\n\n"))).when(by == 2, F.regexp_replace(F.translate(turned, "\t", " "), "[0-7]", "x")).otherwise(source)
    return translation.layout_check(fx.table(spark, sf_dir, "documents").select("doc_id", source.alias("source"), target.alias("target"))).drop("source", "target")


_BLANK_SQL = "NOT regexp_matches(value, '[^\\s\\p{Z}]')"
_NUMBER_SQL = _BLANK_SQL + " OR (regexp_matches(value, '^[=+/*-]') AND regexp_matches(value, '[A-Za-z]+[0-9]')) OR (regexp_matches(value, '^[0-9\\s\\p{Z}.,:%€$krNOK-]+$') AND regexp_matches(value, '[0-9]'))"


@query(f"WITH {fx.CELLS} SELECT doc_id, row, col, {_BLANK_SQL} AS blank, regexp_matches(value, '[A-Za-zÀ-ÿ]') AS letter, {_NUMBER_SQL} AS number FROM cells")
def predicates(spark, sf_dir):
    v = F.col("value")
    return fx.cells(spark, sf_dir).select("doc_id", "row", "col", scalars.is_blank(v).alias("blank"), scalars.has_letter(v).alias("letter"), scalars.looks_numeric(v).alias("number"))


@query(f"""SELECT page_id, md5({fx._ESC.format(x='html')}) AS escaped, md5(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&')) AS decoded,
  chr(CAST(65 + page_id % 500 AS INTEGER)) || '|' || chr(CAST(8300 + page_id AS INTEGER)) || '|' || chr(CAST(97 + page_id % 20 AS INTEGER)) || '|&lt;' AS numeric FROM pages""")
def xml_entities(spark, sf_dir):
    pages = fx.table(spark, sf_dir, "pages")
    k = F.col("page_id")
    # decimal, hexadecimal, a number beyond 65536, and an entity that is itself escaped
    numbers = F.concat(F.lit("&#"), (k % 500 + 65).cast("string"), F.lit(";|&#x"), F.hex(k + 8300), F.lit(";|&#"), (k % 20 + 65536 + 97).cast("string"), F.lit(";|&amp;lt;"))
    return pages.select("page_id", F.md5(scalars.escape_xml(F.col("html")).cast("binary")).alias("escaped"), F.md5(scalars.decode_xml_entities(F.col("html")).cast("binary")).alias("decoded"), scalars.decode_xml_entities(numbers).alias("numeric"))


@query(f"WITH {fx.FILES} SELECT doc_id, ext, CASE WHEN family IS NULL THEN NULL ELSE stem || out_ext END AS out_name, regexp_matches(name, '^src1/.') AS inside, CASE out_ext WHEN '.docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN '.pptx' THEN 'application/vnd.openxmlformats-officedocument.presentationml.presentation' WHEN '.xlsx' THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' WHEN NULL THEN NULL ELSE CASE WHEN out_ext IS NOT NULL THEN 'application/octet-stream' END END AS mime FROM routed")
def file_names(spark, sf_dir):
    up = files.translate_files(fx.files(spark, sf_dir))
    return up.select("doc_id", scalars.upload_ext_of(F.col("name")).alias("ext"), "out_name", scalars.is_inside(F.lit("src1"), F.col("name")).alias("inside"), "mime")


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'Times New Roman' WHEN p_size % 3 = 1 THEN 'Arial' ELSE 'Brand' END AS font, CAST(least(greatest(floor(2 * p_size / 4.0 + 0.5), 16), 192) AS INTEGER) AS half_points,
       CAST(floor(20 * p_retailprice + 0.5) AS INTEGER) AS twips, round(sqrt(p_size * p_size + 1.0), 6) AS size FROM part""")
def style_functions(spark, sf_dir):
    p, n = fx.table(spark, sf_dir, "part"), F.col("p_size")
    name = F.when(n % 3 == 0, "ABCDEF+TimesNewRoman-Bold").when(n % 3 == 1, "Helvetica-Oblique").otherwise("Brand-SemiBold")
    return p.select("p_partkey", scalars.map_font(name).alias("font"), scalars.half_points(n / 4).alias("half_points"), scalars.pt_to_twips(F.col("p_retailprice")).alias("twips"), F.round(scalars.font_size_of(n.cast("double"), F.lit(1.0), F.lit(0.0), F.lit(0.0)), 6).alias("size"))


@query(f"""WITH RECURSIVE {fx.TURN_SEGS}, {fx.BATCHES}, d AS (SELECT doc_id, count(*) AS total, count(*) FILTER (batch_id = 0) AS done FROM b GROUP BY doc_id)
SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY lpad(doc_id::VARCHAR, 12, '0')) - 1 + done / total) / (SELECT count(*) FROM d) * 100 + 0.5) AS INTEGER) AS percent FROM d""")
def overall_progress(spark, sf_dir):
    work, _ = translation.split_blank(fx.turn_segments(spark, sf_dir))
    first = translation.batch_progress(translation.assign_batches(work)).where("batch_id = 0")
    return report.overall_progress(first.withColumn("name", F.lpad(F.col("doc_id").cast("string"), 12, "0"))).select("doc_id", "percent")


@query(f"""SELECT doc_id, CASE WHEN bool_or(regexp_matches(t, '[^\\s\\p{{Z}}]')) THEN 'ok' ELSE 'error' END AS status, CASE WHEN NOT bool_or(regexp_matches(t, '[^\\s\\p{{Z}}]')) THEN '{layout.NO_TEXT}' END AS error
FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x: CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN chr(160) || ' ' ELSE x END)) AS t FROM documents) GROUP BY doc_id""")
def reject_empty_layout(spark, sf_dir):
    rows = plain.lines_to_paragraphs(fx.table(spark, sf_dir, "documents"))
    scanned = F.when(F.col("doc_id") % 6 == 0, "").when(F.col("doc_id") % 6 == 1, "\u00a0 ").otherwise(F.col("text"))
    return layout.reject_empty_layout(rows.withColumn("text", scanned))


@query("SELECT conv_id, turn, CASE WHEN length(p) > 80000 THEN 'Tekstbiten er for stor.' WHEN p = '' THEN 'Mangler tekst å oversette.' END AS error FROM (SELECT *, CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN repeat(text, 400) ELSE text END AS p FROM conversations)")
def guard_prompt(spark, sf_dir):
    text = F.when(F.col("turn") % 3 == 0, " ").when(F.col("turn") % 3 == 1, F.repeat("text", F.lit(400))).otherwise(F.col("text"))
    return translation.guard_prompt(fx.table(spark, sf_dir, "conversations").withColumn("prompt", text)).select("conv_id", "turn", "error")
