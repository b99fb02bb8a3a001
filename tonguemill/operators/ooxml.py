"""Word and slide paragraphs: text out of their markup, and translations back into the run that carries the most of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tonguemill.functions.scalars import BLANK, decode_xml_entities, escape_xml, is_blank, js_length, let


@dataclass(frozen=True)
class Dialect:
    """Element names of a markup dialect."""

    name: str
    prefix: str
    breaks: tuple[str, ...]

    @property
    def paragraph(self) -> str:
        return rf"(?s)<{self.prefix}:p\b.*?</{self.prefix}:p>"

    @property
    def run(self) -> str:
        return rf"(?s)<{self.prefix}:r\b.*?</{self.prefix}:r>"

    @property
    def text(self) -> str:
        return rf"(?s)<{self.prefix}:t\b[^>]*>.*?</{self.prefix}:t>"


DOCX = Dialect("docx", "w", ("br", "cr"))
PPTX = Dialect("pptx", "a", ("br",))
DIALECTS = {d.name: d for d in (DOCX, PPTX)}


def _all(c: Column, pattern: str) -> Column:
    """Every match, whole."""
    return F.regexp_extract_all(c, F.lit(f"({pattern})".replace("((?s)", "(?s)(")), F.lit(1))


def ooxml_plain_text(xml: Column, d: Dialect) -> Column:
    """Text nodes decoded and joined; tabs and breaks become characters. Tab stops count as tabs."""
    p = d.prefix
    names = "|".join(("tab", *d.breaks))
    tokens = F.regexp_extract_all(xml, F.lit(rf"(?s)(<{p}:(?:{names})\b[^/]*/>|<{p}:t\b[^>]*>.*?</{p}:t>)"), F.lit(1))

    def one(t: Column) -> Column:
        other = F.lit(False)
        for b in d.breaks:
            other = other | t.startswith(f"<{p}:{b}")
        inner = F.regexp_replace(F.regexp_replace(t, rf"\A<{p}:t\b[^>]*>", ""), rf"</{p}:t>\z", "")
        return F.when(t.startswith(f"<{p}:tab"), "\t").when(other, "\n").otherwise(decode_xml_entities(inner))

    return F.array_join(F.transform(tokens, one), "")


def ooxml_paragraphs(parts: DataFrame, d: Dialect) -> DataFrame:
    """(doc_id, part, para_idx, xml, text) of every paragraph of parts (doc_id, part, xml). An empty-element paragraph joins the next."""
    rows = parts.select("doc_id", "part", F.posexplode(_all(F.col("xml"), d.paragraph)).alias("para_idx", "xml"))
    return rows.withColumn("text", ooxml_plain_text(F.col("xml"), d))


def ooxml_rows(parts: DataFrame, d: Dialect) -> DataFrame:
    """parts with paras and texts: the markup and the text of each paragraph, null for blank ones. No shuffle."""
    rows = parts.withColumn("paras", _all(F.col("xml"), d.paragraph))
    return rows.withColumn("texts", F.transform("paras", lambda p: let(ooxml_plain_text(p, d), lambda t: F.when(~is_blank(t), t))))


def join_paragraphs(d: Dialect) -> Column:
    """The part of ooxml_rows with their texts in its paragraphs; those with a null or blank text stay as they were."""
    new = lambda p, t: rewrite_paragraph(p, F.when(~is_blank(t), t), d)
    return _interleave(F.col("xml"), d.paragraph, F.zip_with("paras", "texts", new))


def ooxml_segments(parts: DataFrame, d: Dialect) -> DataFrame:
    """segments of the paragraphs that aren't blank; each part is a scope of its own."""
    rows = ooxml_paragraphs(parts, d).where(~is_blank(F.col("text")))
    return rows.select("doc_id", "part", F.col("para_idx").alias("seg_idx"), F.lit("paragraph").alias("kind"), "text")


def paragraph_runs(paragraphs: DataFrame, d: Dialect) -> DataFrame:
    """(doc_id, part, para_idx, run_idx, xml, text, ink_len): ink is what isn't white space."""
    rows = paragraphs.select("doc_id", "part", "para_idx", F.posexplode(_all(F.col("xml"), d.run)).alias("run_idx", "xml"))
    return rows.withColumn("text", ooxml_plain_text(F.col("xml"), d)).withColumn("ink_len", js_length(F.regexp_replace("text", f"[{BLANK}]", "")))


def dominant_run(runs: DataFrame) -> DataFrame:
    """The run with the most ink of each paragraph, the first of equals."""
    w = Window.partitionBy("doc_id", "part", "para_idx").orderBy(F.desc("ink_len"), "run_idx")
    return runs.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def _interleave(source: Column, pattern: str, new: Column) -> Column:
    """source with its matches of pattern replaced by the texts of `new`, in order."""
    return F.array_join(F.zip_with(F.split(source, pattern, -1), new, lambda g, x: F.concat(F.coalesce(g, F.lit("")), F.coalesce(x, F.lit("")))), "")


def rewrite_paragraph(xml: Column, value: Column, d: Dialect, double_breaks: bool = True) -> Column:
    """The paragraph with `value` as the first text of its dominant run and every other text of its runs emptied.

    Unchanged without runs, or where that run has no text node. With double_breaks the source's own breaks stay beside the new ones.
    """
    ink = lambda r: js_length(F.regexp_replace(ooxml_plain_text(r, d), f"[{BLANK}]", ""))
    best = lambda runs: -F.array_max(F.transform(runs, lambda r, i: F.struct(ink(r).alias("ink"), (-i).alias("i"))))["i"]
    chosen = lambda runs: let(best(runs), lambda k: _rewritten(xml, value, d, double_breaks, runs, k, F.get(runs, k)))
    return let(_all(xml, d.run), lambda runs: F.when((F.size(runs) == 0) | value.isNull(), xml).otherwise(chosen(runs)))


def _rewritten(xml: Column, value: Column, d: Dialect, double_breaks: bool, runs: Column, best: Column, own: Column) -> Column:
    p = d.prefix
    texts = _all(own, d.text)
    given = lambda t: F.regexp_extract(t, rf"\A<{p}:t([^>]*)>", 1)

    def attrs(t: Column) -> Column:
        a = given(t)
        return a if d is PPTX else F.when(a.contains("xml:space"), a).otherwise(F.concat(a, F.lit(' xml:space="preserve"')))

    def element(a: Column, content: Column) -> Column:
        return F.concat(F.lit(f"<{p}:t"), a, F.lit(">"), content, F.lit(f"</{p}:t>"))

    first = F.get(texts, F.lit(0))
    lines = F.transform(F.split(value, "\n", -1), lambda x: element(attrs(first), escape_xml(x)))
    # a slide's line ends its run and begins another with the same properties
    props = F.regexp_extract(own, r"(?s)(<a:rPr\b[^>]*/>|<a:rPr\b.*?</a:rPr>)", 1)
    filled = F.concat_ws("", F.array_join(lines, "<w:br/>")) if d is DOCX else _joined(lines, F.concat(F.lit("</a:r><a:br/><a:r>"), props))
    emptied = lambda t: element(attrs(first) if d is PPTX else attrs(t), F.lit(""))
    bare = own if double_breaks else F.regexp_replace(own, rf"<{p}:(?:{'|'.join(d.breaks)})\b[^/]*/>", "")
    run = _interleave(bare, d.text, F.transform(_all(bare, d.text), lambda t, i: F.when(i == 0, filled).otherwise(emptied(t))))
    others = lambda r: _interleave(r, d.text, F.transform(_all(r, d.text), lambda t: element(attrs(t) if d is DOCX else given(t), F.lit(""))))
    out = _interleave(xml, d.run, F.transform(runs, lambda r, i: F.when(i == best, run).otherwise(others(r))))
    return F.when(F.size(texts) == 0, xml).otherwise(out)


def _joined(items: Column, between: Column) -> Column:
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), F.get(items, F.lit(0)), lambda acc, x: F.concat(acc, between, x))


def assemble_part(parts: DataFrame, paragraphs: DataFrame, d: Dialect) -> DataFrame:
    """parts with their paragraphs replaced by those of (doc_id, part, para_idx, xml), which must be all of them."""
    new = paragraphs.groupBy("doc_id", "part").agg(F.transform(F.sort_array(F.collect_list(F.struct("para_idx", "xml"))), lambda x: x["xml"]).alias("new"))
    rows = parts.join(new, ["doc_id", "part"], "left")
    return rows.withColumn("xml", F.when(F.col("new").isNull(), F.col("xml")).otherwise(_interleave(F.col("xml"), d.paragraph, F.col("new")))).drop("new")


def rewrite_parts(parts: DataFrame, translated: DataFrame, d: Dialect) -> DataFrame:
    """parts with translated paragraphs (doc_id, part, seg_idx, text) written into them."""
    paras = ooxml_paragraphs(parts, d).join(translated.select("doc_id", "part", F.col("seg_idx").alias("para_idx"), F.col("text").alias("value")), ["doc_id", "part", "para_idx"], "left")
    return assemble_part(parts, paras.select("doc_id", "part", "para_idx", rewrite_paragraph(F.col("xml"), F.col("value"), d).alias("xml")), d)
