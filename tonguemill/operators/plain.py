"""Plain text, Markdown and RTF: paragraphs to segments and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonguemill.functions.scalars import js_trim

GAP = "\n{2,}"


def normalize_text(c: Column) -> Column:
    """CRLF and lone CR become LF; null is the empty text."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n?", "\n")


def paragraph_rows(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, part, texts, seps): a document's paragraphs, each with the verbatim gap that follows it.

    The last one's gap is the text's final line ends. A leading gap gives an empty first paragraph. No shuffle.
    """
    norm = df.select(F.col(id_col).alias("doc_id"), *keep, normalize_text(F.col(text_col)).alias("norm"))
    cut = norm.withColumn("tail", F.regexp_extract("norm", r"(\n+)\z", 1)).withColumn("core", F.expr("left(norm, length(norm) - length(tail))"))
    seps = F.concat(F.regexp_extract_all("core", F.lit(f"({GAP})"), F.lit(1)), F.array("tail"))
    return cut.select("doc_id", F.lit("").alias("part"), *keep, F.split("core", GAP, -1).alias("texts"), seps.alias("seps"))


def join_paragraphs() -> Column:
    """The text of rows of paragraphs."""
    return F.array_join(F.zip_with("texts", "seps", lambda t, s: F.concat(t, s)), "")


def paragraph_segments(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """segments (doc_id, part, seg_idx, kind, text, sep_after) of paragraph_rows. No shuffle."""
    pairs = F.arrays_zip(F.col("texts").alias("text"), F.col("seps").alias("sep_after"))
    rows = paragraph_rows(df, text_col, id_col).select("doc_id", "part", F.posexplode(pairs).alias("seg_idx", "p"))
    return rows.select("doc_id", "part", "seg_idx", F.lit("paragraph").alias("kind"), "p.text", "p.sep_after")


def assemble_text(segments: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, text): segments with their gaps, in order."""
    pieces = F.sort_array(F.collect_list(F.struct("seg_idx", F.concat(F.col(text_col), "sep_after").alias("t"))))
    return segments.groupBy("doc_id").agg(F.array_join(F.transform(pieces, lambda p: p["t"]), "").alias("text"))


# What is control, and not text, in RTF.
RTF_CONTROL, RTF_BYTE = r"\{\*?\\[^{}]+\}|[{}]|\\[A-Za-z]+\n?(?:-?[0-9]+)?[ ]?", r"\\'[0-9a-fA-F]{2}"


def strip_rtf(c: Column) -> Column:
    """Text of an RTF source: flat control groups, braces and control words go, then escaped bytes, carriage returns and extra lines."""
    body = F.regexp_replace(F.coalesce(c, F.lit("")), RTF_CONTROL, "")
    body = F.regexp_replace(F.regexp_replace(body, RTF_BYTE, ""), "\r", "")
    return js_trim(F.regexp_replace(body, r"\n{3,}", "\n\n"))


def lines_to_paragraphs(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, para_idx, text): one paragraph per line."""
    return df.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.replace(F.col(text_col), F.lit("\r\n"), F.lit("\n")), "\n", -1)).alias("para_idx", "text"))
