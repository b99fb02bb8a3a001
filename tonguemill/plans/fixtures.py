"""Inputs of the queries, derived from the given tables by deterministic expressions, with the same derivation as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonguemill.core.config import FORMATS
from tonguemill.functions.scalars import escape_xml, let


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with paragraphs: every line end doubled; some with final line ends, some with CRLF."""
    t = F.concat(F.replace("text", F.lit("\n"), F.lit("\n\n")), F.when(F.col("doc_id") % 11 == 0, "\n\n\n").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 7 == 0, F.replace(t, F.lit("\n"), F.lit("\r\n"))).otherwise(t).alias("text"))


TEXT_DOCS = """text_docs AS (
  SELECT doc_id, lang, CASE WHEN doc_id % 7 = 0 THEN replace(t, chr(10), chr(13) || chr(10)) ELSE t END AS text
  FROM (SELECT doc_id, lang, replace(text, chr(10), chr(10) || chr(10)) || CASE WHEN doc_id % 11 = 0 THEN repeat(chr(10), 3) ELSE '' END AS t FROM documents)),
norm AS (SELECT doc_id, lang, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS norm FROM text_docs),
core AS (SELECT *, rtrim(norm, chr(10)) AS core FROM norm),
cut AS (SELECT doc_id, lang, norm, string_split_regex(core, '\\n{2,}') AS ps, list_concat(regexp_extract_all(core, '\\n{2,}'), [substr(norm, length(core) + 1)]) AS seps FROM core),
segs AS (SELECT doc_id, i AS seg_idx, ps[i + 1] AS text, seps[i + 1] AS sep_after FROM (SELECT *, unnest(range(len(ps))) AS i FROM cut))"""


def line_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """segments: the lines of documents."""
    return table(spark, sf_dir, "documents").select("doc_id", F.lit("").alias("part"), F.posexplode(F.split("text", "\n", -1)).alias("seg_idx", "text"))


LINE_SEGS = "segs AS (SELECT doc_id, i AS seg_idx, ls[i + 1] AS text FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))"


def turn_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """segments: the turns of conversations."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit("").alias("part"), F.col("turn").cast("int").alias("seg_idx"), "text")


TURN_SEGS = "segs AS (SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS seg_idx, text FROM conversations)"
#: The greedy batches of segs, as a recursion over the k-th segments of all documents.
BATCHES = """work AS (SELECT *, length(text) + 8 AS len, row_number() OVER (PARTITION BY doc_id ORDER BY seg_idx) AS k FROM segs WHERE regexp_matches(text, '[^\\s\\p{Z}\\x{FEFF}]')),
b AS (
  SELECT doc_id, k, seg_idx, 0 AS batch_id, len AS chars, 1 AS n FROM work WHERE k = 1
  UNION ALL
  SELECT w.doc_id, w.k, w.seg_idx, CASE WHEN b.chars + w.len > 7000 OR b.n >= 28 THEN b.batch_id + 1 ELSE b.batch_id END,
         CASE WHEN b.chars + w.len > 7000 OR b.n >= 28 THEN w.len ELSE b.chars + w.len END, CASE WHEN b.chars + w.len > 7000 OR b.n >= 28 THEN 1 ELSE b.n + 1 END
  FROM b JOIN work w ON w.doc_id = b.doc_id AND w.k = b.k + 1)"""


def csv_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One CSV per part: quoted cells with commas and quotes, an unbalanced quote, BOM and CRLF on some, no letters on some."""
    line = F.concat(F.col("p_partkey").cast("string"), F.lit(","), F.col("p_name"), F.lit(',"'), F.col("p_brand"), F.lit(', ""'), F.col("p_type"), F.lit('""",'), F.col("p_size").cast("string"))
    eol = F.when(F.col("p_partkey") % 3 == 0, "\r\n").otherwise("\n")
    text = F.concat(F.when(F.col("p_partkey") % 5 == 0, "\ufeff").otherwise(""), line, eol, F.lit('x,"open '), F.col("p_name"), F.lit(",y"), eol, F.lit(",,"), F.col("p_type"))
    bare = F.concat(F.col("p_size").cast("string"), F.lit(",12"), eol, F.lit("7,8"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.when(F.col("p_partkey") % 17 == 0, bare).otherwise(text).alias("text"))


CSV_DOCS = '''csv_docs AS (
  SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 17 = 0 THEN p_size || ',12' || eol || '7,8' ELSE
    CASE WHEN p_partkey % 5 = 0 THEN chr(65279) ELSE '' END || p_partkey || ',' || p_name || ',"' || p_brand || ', ""' || p_type || '""",' || p_size || eol || 'x,"open ' || p_name || ',y' || eol || ',,' || p_type END AS text
  FROM (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN chr(13) || chr(10) ELSE chr(10) END AS eol FROM part)),
csv_lines AS (SELECT doc_id, i AS row, ls[i + 1] AS line FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split_regex(ltrim(text, chr(65279)), '\\r?\\n') AS ls FROM csv_docs))),
csv_parts AS (SELECT doc_id, row, string_split(array_to_string(list_transform(string_split(line, '"'), lambda x, i: CASE WHEN i % 2 = 1 THEN replace(x, ',', chr(1)) ELSE x END), '"'), chr(1)) AS cs FROM csv_lines),
csv_cells AS (SELECT doc_id, row, i AS col, cs[i + 1] AS cell, replace(regexp_replace(regexp_replace(cs[i + 1], '^"', ''), '"$', ''), '""', '"') AS raw FROM (SELECT *, unnest(range(len(cs))) AS i FROM csv_parts)),
csv_told AS (SELECT *, ltrim(cell) LIKE '"%' AS quoted, regexp_matches(raw, '[A-Za-zÀ-ÿ]') AS eligible FROM csv_cells)'''


def rtf_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as RTF with a font table; every twentieth is one flat group."""
    body = F.replace(F.replace("text", F.lit("\n"), F.lit("\\par\n\n\n")), F.lit("é"), F.lit("\\'e9"))
    rtf = F.when(F.col("doc_id") % 20 == 0, F.concat(F.lit("{\\rtf1 "), body, F.lit("}"))).otherwise(F.concat(F.lit("{\\rtf1{\\fonttbl{\\f0 Arial;}}\\f0\\fs22 "), body, F.lit("\\par}")))
    return table(spark, sf_dir, "documents").select("doc_id", rtf.alias("text"))


RTF_DOCS = """rtf_docs AS (
  SELECT doc_id, CASE WHEN doc_id % 20 = 0 THEN '{\\rtf1 ' || body || '}' ELSE '{\\rtf1{\\fonttbl{\\f0 Arial;}}\\f0\\fs22 ' || body || '\\par}' END AS rtf
  FROM (SELECT doc_id, replace(replace(text, chr(10), '\\par' || chr(10) || chr(10) || chr(10)), 'é', '\\''e9') AS body FROM documents)),
stripped AS (
  SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(rtf, '\\{\\*?\\\\[^{}]+\\}|[{}]|\\\\[A-Za-z]+\\n?(?:-?[0-9]+)?[ ]?', '', 'g'), '\\\\''[0-9a-fA-F]{2}', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS text
  FROM rtf_docs)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as workbook cells: names, types and sizes, amounts, formulas."""
    p = table(spark, sf_dir, "part")
    none = F.lit(None).cast("string")
    cell = lambda col, kind, formula, value: F.struct(F.lit(col).alias("col"), F.lit(kind).alias("type"), formula.alias("formula"), value.cast("string").alias("value"))
    k = F.col("p_partkey")
    amount = F.when(k % 3 == 0, F.concat(F.lit("NOK "), F.col("p_size"))).when(k % 3 == 1, F.lit("=A1+B2")).otherwise(F.concat(F.col("p_size"), F.lit(" esker")))
    row = F.array(cell(0, "s", none, F.col("p_name")), cell(1, "str", F.when(k % 4 == 0, "UPPER(A1)"), F.col("p_type")), cell(2, "n", none, F.col("p_size")), cell(3, "s", none, amount), cell(4, "s", none, F.when(k % 2 == 0, "\u00a0 ").otherwise("12.5 %")))
    return p.select((F.floor(k / 50)).cast("long").alias("doc_id"), F.lit("Ark1").alias("sheet"), (k % 50).cast("int").alias("row"), F.explode(row).alias("c")).select("doc_id", "sheet", "row", "c.*")


CELLS = """raw_cells AS (
  SELECT CAST(p_partkey // 50 AS BIGINT) AS doc_id, 'Ark1' AS sheet, CAST(p_partkey % 50 AS INTEGER) AS row, unnest([
    {'col': 0, 'type': 's', 'formula': NULL, 'value': p_name}, {'col': 1, 'type': 'str', 'formula': CASE WHEN p_partkey % 4 = 0 THEN 'UPPER(A1)' END, 'value': p_type},
    {'col': 2, 'type': 'n', 'formula': NULL, 'value': CAST(p_size AS VARCHAR)},
    {'col': 3, 'type': 's', 'formula': NULL, 'value': CASE p_partkey % 3 WHEN 0 THEN 'NOK ' || p_size WHEN 1 THEN '=A1+B2' ELSE p_size || ' esker' END},
    {'col': 4, 'type': 's', 'formula': NULL, 'value': CASE WHEN p_partkey % 2 = 0 THEN chr(160) || ' ' ELSE '12.5 %' END}]) AS c FROM part),
cells AS (SELECT doc_id, sheet, row, c.col AS col, c.type AS type, c.formula AS formula, c.value AS value FROM raw_cells),
text_cells AS (
  SELECT * FROM cells WHERE formula IS NULL AND type IN ('s', 'str') AND regexp_matches(value, '[^\\s\\p{Z}]')
    AND NOT (regexp_matches(value, '^[=+/*-]') AND regexp_matches(value, '[A-Za-z]+[0-9]')) AND NOT (regexp_matches(value, '^[0-9\\s\\p{Z}.,:%€$krNOK-]+$') AND regexp_matches(value, '[0-9]')))"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest from documents: two in twelve of unsupported types; up to three files share a stem."""
    exts = F.array(*[F.lit(x) for x in [f[0] for f in FORMATS] + [".xyz", ""]])
    name = F.concat("source", F.lit("/d"), F.floor(F.col("doc_id") / 3).cast("string"), F.get(exts, (F.col("doc_id") % 12).cast("int")))
    rows = table(spark, sf_dir, "documents").select("doc_id", name.alias("name"), F.col("n_chars").alias("length"))
    return rows.select("doc_id", F.concat(F.lit("/in/"), "name").alias("path"), "name", "length", F.get(exts, (F.col("doc_id") % 12).cast("int")).alias("ext"))


#: Names and their places in Norwegian order.
NAMES = {"zoo": 3, "ære": 4, "Alt": 1, "b": 2, "øre": 5, "aa": 6, "åre": 7}


def norwegian_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each document, seven in a folder."""
    name = F.get(F.array(*[F.lit(x) for x in NAMES]), (F.col("doc_id") % len(NAMES)).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/in/"), F.floor(F.col("doc_id") / len(NAMES)).cast("string"), F.lit("/"), name).alias("path"))


_VALUES = ", ".join(f"('{e}', '{o}', '{f}')" for e, o, f, _ in FORMATS)
FILES = f"""formats(ext, out_ext, family) AS (VALUES {_VALUES}),
files AS (
  SELECT doc_id, source || '/d' || CAST(doc_id // 3 AS VARCHAR) || ext AS name, source || '/d' || CAST(doc_id // 3 AS VARCHAR) AS stem, n_chars AS length, ext
  FROM (SELECT *, [{", ".join(f"'{f[0]}'" for f in FORMATS)}, '.xyz', ''][doc_id % 12 + 1] AS ext FROM documents)),
routed AS (SELECT f.*, out_ext, family, CASE WHEN family IS NOT NULL THEN '/ut/' || stem || out_ext END AS dest FROM files f LEFT JOIN formats USING (ext)),
existing AS (SELECT DISTINCT dest FROM routed WHERE doc_id % 5 = 0 AND dest IS NOT NULL)"""


def ooxml_parts(spark: SparkSession, sf_dir: str, prefix: str = "w") -> DataFrame:
    """A part for each turn: lines are paragraphs, what commas separate are runs, with tabs between."""
    p = prefix
    runs = lambda x: F.array_join(F.transform(F.split(x, ", ", -1), lambda r: F.concat(F.lit(f"<{p}:r><{p}:rPr b=\"1\"/><{p}:t>"), escape_xml(r), F.lit(f"</{p}:t></{p}:r>"))), f"<{p}:r><{p}:tab/></{p}:r>")
    body = F.array_join(F.transform(F.split("text", "\n", -1), lambda x: F.concat(F.lit(f"<{p}:p><{p}:pPr/>"), runs(x), F.lit(f"</{p}:p>"))), "")
    part = "word/document.xml" if p == "w" else "ppt/slides/slide1.xml"
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.lit(part).alias("part"), F.concat(F.lit("<x>"), body, F.lit("</x>")).alias("xml"))


_ESC = "replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"
OOXML = """lines AS (SELECT conv_id * 1000 + turn AS doc_id, CAST(i AS INTEGER) AS para_idx, ls[i + 1] AS line FROM (SELECT *, string_split(text, chr(10)) AS ls, unnest(range(len(string_split(text, chr(10))))) AS i FROM conversations)),
paras AS (SELECT *, string_split(line, ', ') AS rs FROM lines),
told AS (SELECT *, array_to_string(rs, chr(9)) AS text, list_position(list_transform(rs, lambda r: length(regexp_replace(r, '\\s', '', 'g'))), list_max(list_transform(rs, lambda r: length(regexp_replace(r, '\\s', '', 'g'))))) AS best FROM paras)"""


def workbook_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as workbooks of fifty rows: names are shared strings, types inline ones, sizes numbers."""
    k = F.col("p_partkey")
    row = (k % 50).cast("int")
    at = lambda letter: F.concat(F.lit(f'<c r="{letter}'), (row + 1).cast("string"), F.lit('"'))
    cells_ = F.concat(at("A"), F.lit(' t="s"><v>'), row.cast("string"), F.lit("</v></c>"), at("B"), F.lit(' t="inlineStr"><is><t>'), escape_xml(F.col("p_type")), F.lit("</t></is></c>"), at("C"), F.lit("><v>"), F.col("p_size").cast("string"), F.lit("</v></c>"))
    books = table(spark, sf_dir, "part").select(F.floor(k / 50).cast("long").alias("doc_id"), row.alias("row"), cells_.alias("cells"), F.concat(F.lit("<si><t>"), escape_xml(F.col("p_name")), F.lit("</t></si>")).alias("si"))
    # shared strings are numbered from 0 by row, so missing rows have empty ones
    own = books.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("row", "cells", "si"))).alias("x"))
    strings = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(49)), lambda i: F.coalesce(F.get(F.filter("x", lambda r: r["row"] == i), F.lit(0))["si"], F.lit("<si/>"))), "")
    sheet = F.concat(F.lit("<worksheet><sheetData>"), F.array_join(F.transform("x", lambda r: F.concat(F.lit("<row>"), r["cells"], F.lit("</row>"))), ""), F.lit("</sheetData></worksheet>"))
    parts = F.array(F.struct(F.lit("xl/worksheets/sheet1.xml").alias("part"), sheet.alias("xml")), F.struct(F.lit("xl/sharedStrings.xml").alias("part"), F.concat(F.lit("<sst>"), strings, F.lit("</sst>")).alias("xml")))
    return own.select("doc_id", F.explode(parts).alias("p")).select("doc_id", "p.part", "p.xml")


def layout_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page, ls): documents by pages of fifty lines."""
    pages = let(F.split("text", "\n", -1), lambda ls: F.transform(F.sequence(F.lit(0), F.floor((F.size(ls) - 1) / 50).cast("int")), lambda p: F.slice(ls, p * 50 + 1, F.lit(50))))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(pages).alias("page", "ls"))


def glyph_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw glyphs of documents: a line for each line, a glyph for each word, fifty lines on a page. What is shuffled are the pages' texts, also
    where rows share a doc_id; a page's glyphs then stand together."""
    pages = layout_pages(spark, sf_dir).repartition("doc_id", "page").sortWithinPartitions("doc_id", "page")
    lines = pages.select("doc_id", "page", F.posexplode("ls").alias("n", "line"))
    words = lines.select("doc_id", "page", "n", F.posexplode(F.split("line", " ", -1)).alias("w", "str"))
    n, size = F.col("n"), F.when(F.col("n") % 10 == 0, 16.0).otherwise(11.0)
    y = 800.0 - n * 15.0 - F.floor(n / 7) * 20.0 + ((F.col("doc_id") * 7 + F.col("w")) % 3) * 0.25
    x = F.when(n % 10 == 0, 200.0).otherwise(50.0) + F.col("w") * 60.0
    font = F.when(n % 10 == 0, "ABCDEF+Times-Bold").when(n % 10 == 5, "Arial-Italic").otherwise("Helvetica")
    zero = F.lit(0.0)
    return words.select("doc_id", "page", (n * 1_000_000 + F.col("w")).cast("int").alias("item_idx"), "str", F.array(size, zero, zero, size, x, y).alias("transform"), (F.length("str") * 5.0).alias("width"), font.alias("font_name"))


def page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a glyph."""
    some = layout_pages(spark, sf_dir).where(F.exists("ls", lambda x: x.rlike("[^ ]")))
    return some.select("doc_id", "page").distinct().select("doc_id", "page", F.lit(595.0).alias("width"), F.lit(842.0).alias("height"))


GLYPHS = """gl AS (SELECT doc_id, i AS l, ls[i + 1] AS line FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
gw AS (SELECT doc_id, l, i AS w, ws[i + 1] AS str FROM (SELECT doc_id, l, ws, unnest(range(len(ws))) AS i FROM (SELECT doc_id, l, string_split(line, ' ') AS ws FROM gl))),
glyphs AS (SELECT doc_id, CAST(l // 50 AS INTEGER) AS page, l, w, str, CASE WHEN l % 10 = 0 THEN 16.0::DOUBLE ELSE 11.0 END AS font_size,
    800.0::DOUBLE - (l % 50) * 15.0 - ((l % 50) // 7) * 20.0 + ((doc_id * 7 + w) % 3) * 0.25 AS y, CASE WHEN l % 10 = 0 THEN 200.0::DOUBLE ELSE 50.0 END + w * 60.0::DOUBLE AS x, length(str) * 5.0::DOUBLE AS width,
    CASE WHEN l % 10 = 0 THEN 'ABCDEF+Times-Bold' WHEN l % 10 = 5 THEN 'Arial-Italic' ELSE 'Helvetica' END AS font_name FROM gw WHERE str <> ''),
spaced AS (SELECT *, CASE WHEN x - lag(x + width) OVER (PARTITION BY doc_id, l ORDER BY w) > font_size * 0.22 THEN ' ' ELSE '' END || str AS s FROM glyphs),
lines0 AS (SELECT doc_id, page, l, rtrim(string_agg(s, '' ORDER BY w), ' ' || chr(9)) AS text, max(y) AS y, min(x) AS x, arg_max(x + width, w) AS x_end, any_value(font_size) AS font_size, any_value(font_name) AS font_name FROM spaced GROUP BY doc_id, page, l),
lines1 AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY l) - 1 AS INTEGER) AS line_idx, font_name LIKE '%Bold%' AS bold, font_name LIKE '%Italic%' AS italic FROM lines0),
lines2 AS (SELECT *, lag(y) OVER w - y AS gap, lag(font_size) OVER w AS size_before, lag(y) OVER w IS NULL OR lag(y) OVER w - y > lag(font_size) OVER w * 1.55 OR abs(lag(font_size) OVER w - font_size) >= 0.9 OR lag(bold) OVER w <> bold AS starts FROM lines1 WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_idx)),
grouped AS (SELECT *, CAST(sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY line_idx) - 1 AS INTEGER) AS para_idx FROM lines2),
paras0 AS (
  SELECT doc_id, page, para_idx, string_agg(text, chr(10) ORDER BY line_idx) AS text, arg_min(font_size, (-length(text)) * 1000 + line_idx) AS font_size, arg_min(font_name, (-length(text)) * 1000 + line_idx) AS font_name,
         arg_min(bold, (-length(text)) * 1000 + line_idx) AS bold, arg_min(italic, (-length(text)) * 1000 + line_idx) AS italic, min(x) AS lft, max(x_end) AS rgt, avg(font_size) AS av,
         max(CASE WHEN starts AND gap > size_before * 2.2 THEN CAST(floor((gap - size_before) * 10 + 0.5) AS INTEGER) ELSE 0 END) AS extra
  FROM grouped GROUP BY doc_id, page, para_idx),
styled AS (SELECT *, CASE WHEN abs((lft + rgt) / 2 - 297.5) < 59.5 AND lft > 595 * 0.16 THEN 'center' WHEN lft > 595 * 0.48 THEN 'right' ELSE 'left' END AS align, 0 AS space_before,
    coalesce(lead(extra) OVER (PARTITION BY doc_id, page ORDER BY para_idx), 0) AS space_after, CAST(floor(av * 20 * 1.15 + 0.5) AS INTEGER) AS line_twips FROM paras0)"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a model from conversations: three shapes, and fenced, short, broken and refused ones by turn."""
    items = F.split("text", "\n", -1)
    answer = F.when(F.col("turn") % 5 == 1, F.concat(F.lit("```json\n"), F.to_json(items), F.lit("\n```"))).otherwise(F.to_json(items))
    shapes = [F.to_json(F.struct(answer.alias("output_text"))), F.to_json(F.struct(F.array(F.struct(F.array(F.struct(answer.alias("text"))).alias("content"))).alias("output"))), F.to_json(F.struct(F.array(F.struct(F.struct(answer.alias("content")).alias("message"))).alias("choices")))]
    body = F.when(F.col("turn") % 5 == 3, F.concat(F.lit("oops "), "text")).when(F.col("turn") % 5 == 4, F.lit('{"error":{"message":"overloaded"}}'))
    for k, shape in enumerate(shapes):
        body = body.when(F.col("conv_id") % 3 == k, shape)
    expected = F.size(items) + F.when(F.col("turn") % 5 == 2, 1).otherwise(0)
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit("").alias("part"), F.col("turn").cast("int").alias("batch_id"), F.when(F.col("turn") % 5 == 4, 500).otherwise(200).alias("http_status"), expected.alias("expected"), body.alias("body"))


RESPONSES = """told AS (
  SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS batch_id, text, string_split(text, chr(10)) AS items, turn % 5 AS fault,
         CASE turn % 5 WHEN 2 THEN 'Forventet ' || (len(string_split(text, chr(10))) + 1) || ' oversettelser, fikk ' || len(string_split(text, chr(10))) || '.' WHEN 3 THEN left('oops ' || text, 240) WHEN 4 THEN 'overloaded' END AS error
  FROM conversations)"""
