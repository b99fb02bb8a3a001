"""Workbook cells: which are translated, and their values put back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tonguemill.functions.scalars import is_blank, looks_numeric


def workbook_text_cells(cells: DataFrame) -> DataFrame:
    """Cells (doc_id, sheet, row, col, type, formula, value) that hold text: no formula, a string type, not blank, not a number."""
    plain = F.col("formula").isNull() & F.col("type").isin("s", "str")
    return cells.where(plain & ~is_blank(F.col("value")) & ~looks_numeric(F.col("value")))


def cell_segments(cells: DataFrame) -> DataFrame:
    """segments of the text cells, sheets in order of name and cells row by row; seg_idx is dense in the document."""
    order = Window.partitionBy("doc_id").orderBy("sheet", "row", "col")
    rows = workbook_text_cells(cells).withColumn("seg_idx", F.row_number().over(order) - 1)
    return rows.select("doc_id", F.lit("").alias("part"), "seg_idx", F.lit("cell").alias("kind"), F.col("value").alias("text"), "sheet", "row", "col")


def assemble_cells(cells: DataFrame, translated: DataFrame) -> DataFrame:
    """cells with new values (doc_id, sheet, row, col, text); changed cells become strings."""
    new = translated.select("doc_id", "sheet", "row", "col", F.col("text").alias("new"))
    out = cells.join(new, ["doc_id", "sheet", "row", "col"], "left")
    return out.withColumn("value", F.coalesce("new", "value")).withColumn("type", F.when(F.col("new").isNotNull(), "s").otherwise(F.col("type"))).withColumn("changed", F.col("new").isNotNull()).drop("new")
