"""HTML: text between tags to segments and back, by position alone; a document without such text is a plain one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonguemill.functions.scalars import escape_xml, has_letter, is_blank, js_length, let, overlay
from tonguemill.operators.plain import paragraph_segments


def _pieces(html: Column) -> Column:
    """What stands between `<` and the next: chunk, prefix up to its first `>`, raw after that, and slot (raw is text to translate)."""

    def piece(own: Column, x: Column, i: Column) -> Column:
        at = F.instr(x, ">")
        raw = F.when(at > 0, F.substr(x, at + 1))
        slot = raw.isNotNull() & (i < F.size(own) - 1) & (js_length(raw) >= 3) & ~is_blank(raw) & has_letter(raw)
        return F.struct(x.alias("chunk"), F.left(x, at).alias("prefix"), raw.alias("raw"), F.coalesce(slot, F.lit(False)).alias("slot"))

    return let(F.split(F.coalesce(html, F.lit("")), "<", -1), lambda own: F.transform(own, lambda x, i: piece(own, x, i)))


def html_rows(df: DataFrame, html_col: str = "html", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, part, pieces, texts): the texts of slots at their chunks' places, null at others. No shuffle."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.lit("").alias("part"), _pieces(F.col(html_col)).alias("pieces"))
    return rows.withColumn("texts", F.transform("pieces", lambda p: F.when(p["slot"], p["raw"])))


def join_slots(escape: bool = False) -> Column:
    """The document of html_rows with their texts in the slots, unescaped unless asked for; a null text leaves its slot as it was."""
    out = lambda p, t: F.when(p["slot"] & t.isNotNull(), F.concat(p["prefix"], escape_xml(t) if escape else t)).otherwise(p["chunk"])
    return F.array_join(F.zip_with("pieces", "texts", out), "<")


def html_text_segments(df: DataFrame, html_col: str = "html", id_col: str = "doc_id") -> DataFrame:
    """segments of the slots; seg_idx is the chunk's number. No shuffle."""
    rows = html_rows(df, html_col, id_col).select("doc_id", "part", F.posexplode("pieces").alias("seg_idx", "p")).where("p.slot")
    return rows.select("doc_id", "part", "seg_idx", F.lit("slot").alias("kind"), F.col("p.raw").alias("text"))


def has_slots(html: Column) -> Column:
    """The document has a slot, told without exploding it."""
    return F.exists(_pieces(html), lambda p: p["slot"])


def html_segments(df: DataFrame, html_col: str = "html", id_col: str = "doc_id") -> DataFrame:
    """Slots, or paragraphs of the whole source where there is no slot."""
    told = df.withColumn("__slots", has_slots(F.col(html_col)))
    plain = paragraph_segments(told.where("not __slots"), html_col, id_col)
    return html_text_segments(told.where("__slots"), html_col, id_col).withColumn("sep_after", F.lit("")).unionByName(plain)


def assemble_html(df: DataFrame, translated: DataFrame, html_col: str = "html", id_col: str = "doc_id", escape: bool = False) -> DataFrame:
    """(doc_id, html) with each slot's translation (doc_id, seg_idx, text) in its place, unescaped unless asked for."""
    new = translated.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("seg_idx").alias("i"), F.col("text").alias("t"))).alias("new"))
    rows = html_rows(df, html_col, id_col).join(new, "doc_id", "left").withColumn("texts", F.transform("pieces", lambda p: F.lit(None).cast("string")))
    return rows.withColumn("texts", overlay(F.col("texts"), F.coalesce("new", F.array()))).select("doc_id", join_slots(escape).alias("html"))
