"""Page layout: glyphs to lines, lines to styled paragraphs, pages to one document, paragraphs to word-processing markup.

A page is the unit of grouping, so what is collected is a page's glyphs; documents of any length only have more pages. Glyphs become lines in
one pass over Arrow batches; from there on rows are lines and paragraphs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tonguemill.functions.scalars import escape_xml, font_size_of, half_points, js_length, js_round, map_font, pt_to_twips

PAGE = ("doc_id", "page")
# What a font's name says of its weight and slant.
HEAVY, SLANTED = "(?i)bold|black|heavy|semibold|demi", "(?i)italic|oblique"
NO_TEXT = "Fant ingen tekst i PDF-en (kan være skannet uten OCR)."


def normalize_glyphs(items: DataFrame) -> DataFrame:
    """glyphs from raw items (doc_id, page, item_idx, str, transform array<double>, width, font_name); empty strings go."""
    t = lambda i: F.get("transform", F.lit(i))
    size = font_size_of(F.coalesce(t(0), F.lit(1.0)), F.coalesce(t(1), F.lit(0.0)), F.coalesce(t(2), F.lit(0.0)), F.coalesce(t(3), F.lit(1.0)))
    return items.where(F.coalesce("str", F.lit("")) != "").select(*PAGE, "item_idx", "str", F.coalesce(t(4), F.lit(0.0)).alias("x"), F.coalesce(t(5), F.lit(0.0)).alias("y"), F.coalesce("width", F.lit(0.0)).alias("width"), size.alias("font_size"), F.coalesce("font_name", F.lit("")).alias("font_name"))


LINES = "doc_id {id}, page int, line_idx int, y double, n_items int, text string, font_size double, font_name string, names string, x double, x_end double"


def cluster_lines(glyphs: DataFrame, gathered: bool = False) -> DataFrame:
    """(doc_id, page, line_idx, y, n_items, text, font_size, font_name, names, x, x_end): from the top, left to right; a glyph joins the
    line whose first glyph is near enough in y.

    A blank stands where the gap to the glyph before is over 0.22 of the size. The size is the upper median, the font that of the
    longest glyph (the first of equals); names are the line's fonts. With `gathered` a page's glyphs already stand together in one partition,
    as they do where its row was exploded; else they are shuffled to stand so. A task holds a page at a time, and Arrow's batches.
    """
    if not gathered:
        glyphs = glyphs.repartition(*PAGE).sortWithinPartitions(*PAGE)
    kind = glyphs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            begins = _page_begins(batch, held[-1] if held else None)
            if not len(begins):
                held.append(batch)
                continue
            yield from _lines_of([*held, batch.slice(0, begins[-1])])
            held = [batch.slice(begins[-1])]
        yield from _lines_of(held)

    return glyphs.select(*PAGE, F.col("item_idx").cast("long"), "str", "x", "y", "width", "font_size", "font_name").mapInArrow(run, LINES.format(id=kind.simpleString()))


def _codes(column: pa.Array) -> np.ndarray:
    """A number for each distinct value, null included."""
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy()


def _page_begins(batch: pa.RecordBatch, before: pa.RecordBatch | None) -> np.ndarray:
    """Rows of a batch that begin a page, the first one if it isn't of the page of the rows before."""
    if not batch.num_rows:
        return np.empty(0, int)
    doc, page = _codes(batch.column(0)), _codes(batch.column(1))
    first = before is not None and before.num_rows and any(before.column(k)[before.num_rows - 1].as_py() != batch.column(k)[0].as_py() for k in (0, 1))
    inside = np.flatnonzero((doc[1:] != doc[:-1]) | (page[1:] != page[:-1])) + 1
    return np.append(0, inside) if first else inside


def _over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a > b as Spark has it: NaN is over all else."""
    return (a > b) | (np.isnan(a) & ~np.isnan(b))


def _utf16(texts: pa.Array) -> np.ndarray:
    """Lengths in UTF-16 units: a character of four bytes is two."""
    n = pc.utf8_length(texts).to_numpy().copy()
    for i in np.flatnonzero(pc.binary_length(texts).to_numpy() - n > 2):
        n[i] = len(texts[i].as_py().encode("utf-16-le", "surrogatepass")) // 2
    return n


def _lines_of(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of whole pages."""
    t = pa.Table.from_batches(batches).combine_chunks() if batches else None
    if t is None or not t.num_rows:
        return
    doc, page, idx, texts, x, y, width, size, font = (c.chunk(0) for c in t.columns)
    number = np.append(0, np.cumsum((np.diff(_codes(doc)) != 0) | (np.diff(_codes(page)) != 0)))
    idx = pc.fill_null(idx, -(1 << 62)).to_numpy()
    x, width, size, down = x.to_numpy(), width.to_numpy(), size.to_numpy(), -y.to_numpy()
    order = np.lexsort((idx, x, down, number))
    same = np.append(False, np.all([c[order][1:] == c[order][:-1] for c in (idx, x, down, number)], axis=0))
    for a in np.flatnonzero(~same & np.append(same[1:], False)):  # glyphs of one place and number, by what else they are
        b = a + 1
        while b < len(order) and same[b]:
            b += 1
        order[a:b] = sorted(order[a:b], key=lambda i: (texts[i].as_py().encode("utf-8", "surrogatepass"), width[i], size[i], font[i].as_py().encode()))
    number, x, width, size, down = (c[order] for c in (number, x, width, size, down))
    starts, cur, anchor = [], -1, 0.0
    for i, (own, at, near) in enumerate(zip(number.tolist(), down.tolist(), np.maximum(1.6, size * 0.32).tolist(), strict=True)):
        if own != cur or not abs(anchor - at) <= near:
            starts.append(i)
            cur, anchor = own, at
    a = np.array(starts)
    count = np.diff(np.append(a, len(order)))
    line = np.repeat(np.arange(len(a)), count)
    # by x; glyphs at the same x keep the order in which they came
    by_x = np.lexsort((x, line))
    order, x, end, size, last = order[by_x], x[by_x], (x + width)[by_x], size[by_x], a + count - 1
    blank = np.append(False, _over(x[1:] - end[:-1], size[1:] * 0.22))
    blank[a] = False
    taken = pa.array(order)
    strs, fonts = texts.take(taken), font.take(taken).dictionary_encode()
    words = [" " + s if gap else s for s, gap in zip(strs.to_pylist(), blank.tolist(), strict=True)]
    codes, names = fonts.indices.to_numpy(), fonts.dictionary.to_pylist()
    main = codes[np.lexsort((-_utf16(strs), line))][a]
    mixed = np.minimum.reduceat(codes, a) != np.maximum.reduceat(codes, a)
    spans = list(zip(a.tolist(), (last + 1).tolist(), strict=True))
    first = np.searchsorted(number[a], number[a])  # a page's first line
    where = pa.array(order[a])
    columns = [
        doc.take(where), page.take(where), pa.array(np.arange(len(a)) - first, pa.int32()), pa.array(-down[a]), pa.array(count, pa.int32()),
        pa.array(["".join(words[i:j]).rstrip(" \t") for i, j in spans], pa.string()), pa.array(size[np.lexsort((size, line))][a + count // 2]), pa.array([names[c] for c in main], pa.string()),
        pa.array([" ".join(sorted(names[c] for c in np.unique(codes[i:j]))) if many else names[c] for (i, j), many, c in zip(spans, mixed.tolist(), main.tolist(), strict=True)], pa.string()),
        pa.array(x[a]), pa.array(end[last]),
    ]
    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "page", "line_idx", "y", "n_items", "text", "font_size", "font_name", "names", "x", "x_end"])


def assemble_lines(lines: DataFrame) -> DataFrame:
    """lines (doc_id, page, line_idx, text, font_size, font_name, bold, italic, x, y, x_end); empty ones go. Bold and italic hold if any font
    of the line says so."""
    names = F.col("names")
    return lines.where("text <> ''").select(*PAGE, "line_idx", "text", "font_size", "font_name", names.rlike(HEAVY).alias("bold"), names.rlike(SLANTED).alias("italic"), "x", "y", "x_end")


def paragraph_groups(lines: DataFrame) -> DataFrame:
    """lines with para_idx in the page, starts (it begins a paragraph) and gap (to the line before).

    A paragraph begins where the gap is over 1.55 of the size before, the size changes by 0.9 or more, or the weight changes.
    """
    w = Window.partitionBy(*PAGE).orderBy("line_idx")
    before = lambda c: F.lag(c).over(w)
    gap = before("y") - F.col("y")
    begins = before("y").isNull() | (gap > before("font_size") * 1.55) | (F.abs(before("font_size") - F.col("font_size")) >= 0.9) | (before("bold") != F.col("bold"))
    told = lines.withColumn("gap", gap).withColumn("size_before", before("font_size")).withColumn("starts", begins)
    return told.withColumn("para_idx", (F.sum(F.col("starts").cast("int")).over(w) - 1).cast("int"))


def paragraph_style(grouped: DataFrame, page_sizes: DataFrame) -> DataFrame:
    """(doc_id, page, para_idx, text, font_size, font_name, bold, italic, left, align, space_before, space_after, line_twips).

    Style is that of the longest line (the first of equals). Alignment is told from the margins; a gap of over 2.2 of the size before
    gives the paragraph above it room after.
    """
    longest = F.max_by(F.struct("font_size", "font_name", "bold", "italic"), F.struct(js_length(F.col("text")), -F.col("line_idx")))
    extra = F.when(F.col("starts") & (F.col("gap") > F.col("size_before") * 2.2), js_round((F.col("gap") - F.col("size_before")) * 10)).otherwise(0)
    paras = grouped.withColumn("extra", extra).groupBy(*PAGE, "para_idx").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_idx", "text"))), lambda x: x["text"]), "\n").alias("text"),
        longest.alias("m"), F.min("x").alias("left"), F.max("x_end").alias("right"), F.avg("font_size").alias("avg"), F.max("extra").alias("extra"),
    )
    sized = paras.join(page_sizes.select(*PAGE, "width"), [*PAGE], "left")
    width = F.coalesce("width", F.lit(595.0))
    middle = (F.col("left") + F.col("right")) / 2
    align = F.when((F.abs(middle - width / 2) < width * 0.1) & (F.col("left") > width * 0.16), "center").when(F.col("left") > width * 0.48, "right").otherwise("left")
    after = F.coalesce(F.lead("extra").over(Window.partitionBy(*PAGE).orderBy("para_idx")), F.lit(0)).cast("int")
    return sized.select(*PAGE, "para_idx", "text", "m.*", "left", align.alias("align"), F.lit(0).alias("space_before"), after.alias("space_after"), js_round(F.col("avg") * 20 * 1.15).cast("int").alias("line_twips"))


def stitch_pages(styled: DataFrame, page_sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paragraphs of the document in order, each with its margin; (doc_id, width, height, margin)).

    Before every page but the first stands an empty paragraph with 240 before it. The margin is the least x of the paragraphs within 36
    and 90, 56 without any; the page is the first one's.
    """
    clamp = lambda c: F.coalesce(F.least(F.greatest(js_round(c), F.lit(36)), F.lit(90)), F.lit(56)).cast("int")
    rows = styled.withColumn("k", F.col("para_idx") + 1)
    own = Window.partitionBy("doc_id")
    seps = page_sizes.withColumn("first", F.min("page").over(own)).where(F.col("page") > F.col("first")).select("doc_id", "page", F.lit(0).alias("k"), F.lit("").alias("text"), F.lit(240).alias("space_before"))
    both = rows.drop("para_idx").unionByName(seps, allowMissingColumns=True)
    paras = both.withColumn("para_idx", F.row_number().over(own.orderBy("page", "k")) - 1).withColumn("margin", clamp(F.min("left").over(own))).drop("k", "left")
    first = page_sizes.groupBy("doc_id").agg(F.min_by(F.struct("width", "height"), "page").alias("s"))
    least = styled.groupBy("doc_id").agg(F.min("left").alias("x"))
    return paras, first.join(least, "doc_id", "left").select("doc_id", "s.width", "s.height", clamp(F.col("x")).alias("margin"))


def reject_empty_layout(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, status, error): a document without text (scanned, perhaps) is an error."""
    text = F.bool_or(F.col("text").rlike(r"[^\s\p{Z}\x{FEFF}]"))
    return paragraphs.groupBy("doc_id").agg(text.alias("t")).select("doc_id", F.when(F.col("t"), "ok").otherwise("error").alias("status"), F.when(~F.col("t"), NO_TEXT).alias("error"))


def paragraph_xml(p: DataFrame, compact: bool = True) -> DataFrame:
    """p with xml: a word-processing paragraph with alignment, spacing, run properties and a break run for each further line."""
    c = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in p.columns else F.lit(default)
    font, size = escape_xml(map_font(c("font_name", ""))), half_points(c("font_size", 11.0)).cast("string")
    props = F.concat(F.lit('<w:rPr><w:rFonts w:ascii="'), font, F.lit('" w:hAnsi="'), font, F.lit('" w:cs="'), font, F.lit('"/><w:sz w:val="'), size, F.lit('"/><w:szCs w:val="'), size, F.lit('"/>'), F.when(c("bold", False), "<w:b/><w:bCs/>").otherwise(""), F.when(c("italic", False), "<w:i/><w:iCs/>").otherwise(""), F.lit("</w:rPr>"))
    align = F.when(c("align", "left") != "left", F.concat(F.lit('<w:jc w:val="'), c("align", "left"), F.lit('"/>'))).otherwise("")
    spacing = F.concat(F.lit("<w:pPr>"), align, F.lit('<w:spacing w:before="'), c("space_before", 0).cast("string"), F.lit('" w:after="'), c("space_after", 0 if compact else 160).cast("string"), F.lit('" w:line="'), c("line_twips", 240 if compact else 276).cast("string"), F.lit('" w:lineRule="auto"/></w:pPr>'))
    run = lambda inner: F.concat(F.lit("<w:r>"), props, inner, F.lit("</w:r>"))
    line = lambda x: run(F.concat(F.lit('<w:t xml:space="preserve">'), escape_xml(x), F.lit("</w:t>")))
    runs = F.array_join(F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(F.when(i > 0, run(F.lit("<w:br/>"))).otherwise(""), line(x))), "")
    body = F.when(F.coalesce("text", F.lit("")) == "", "").otherwise(runs)
    return p.withColumn("xml", F.concat(F.lit("<w:p>"), spacing, body, F.lit("</w:p>")))


def document_xml(paragraphs: DataFrame, pages: DataFrame | None = None, compact: bool = True) -> DataFrame:
    """(doc_id, xml): the body part of a new document. Without page sizes: A4 with a margin of 1134 twips."""
    body = paragraph_xml(paragraphs, compact).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("para_idx", "xml"))), lambda x: x["xml"]), "").alias("body"))
    rows = body.join(pages, "doc_id", "left") if pages is not None else body.withColumns({k: F.lit(None).cast("double") for k in ("width", "height", "margin")})
    w, h, m = (F.coalesce(pt_to_twips(F.col(k)), F.lit(d)).cast("string") for k, d in (("width", 11906), ("height", 16838), ("margin", 1134)))
    sect = F.concat(F.lit('<w:sectPr><w:pgSz w:w="'), w, F.lit('" w:h="'), h, F.lit('"/><w:pgMar w:top="'), m, F.lit('" w:right="'), m, F.lit('" w:bottom="'), m, F.lit('" w:left="'), m, F.lit('"/></w:sectPr>'))
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>'
    return rows.select("doc_id", F.concat(F.lit(head), "body", sect, F.lit("</w:body></w:document>")).alias("xml"))
