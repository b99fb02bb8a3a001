"""CSV: cells to segments and back. The quote state starts anew on every line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonguemill.functions.scalars import BLANK, has_letter, is_blank, let

_MARK = "\u0001"


def csv_rows(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, part, source, cells, texts): every cell with row, col, cell, raw, quoted and eligible, and the texts of the eligible at
    their cells' places, null at others. Commas outside quotes are those in even chunks between quotes. No shuffle."""
    body = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "\\A\ufeff", "")
    marked = lambda line: F.array_join(F.transform(F.split(line, '"', -1), lambda x, i: F.when(i % 2 == 0, F.translate(x, ",", _MARK)).otherwise(x)), '"')

    def cell(row: Column, col: Column, x: Column) -> Column:
        raw = F.replace(F.regexp_replace(x, r'\A"|"\z', ""), F.lit('""'), F.lit('"'))
        return F.struct(row.alias("row"), col.alias("col"), x.alias("cell"), raw.alias("raw"), x.rlike(rf'\A[{BLANK}]*"').alias("quoted"), (~is_blank(raw) & has_letter(raw)).alias("eligible"))

    cells = F.flatten(F.transform(F.split(body, "\r?\n", -1), lambda line, r: F.transform(F.split(marked(line), _MARK, -1), lambda x, k: cell(r, k, x))))
    rows = df.select(F.col(id_col).alias("doc_id"), F.lit("").alias("part"), F.col(text_col).alias("source"), cells.alias("cells"))
    return rows.withColumn("texts", F.transform("cells", lambda c: F.when(c["eligible"], c["raw"])))


def join_cells() -> Column:
    """The source of csv_rows with their texts in the eligible cells. Documents without any keep their source as it was."""

    def out(c: Column, t: Column) -> Column:
        escaped = F.replace(t, F.lit('"'), F.lit('""'))
        new = F.when(c["quoted"] | escaped.rlike('[",\n]'), F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(escaped)
        # a cell in the first column begins a line
        return F.concat(F.when(c["col"] > 0, ",").when(c["row"] > 0, "\n").otherwise(""), F.when(c["eligible"] & t.isNotNull(), new).otherwise(c["cell"]))

    joined = let(F.array_join(F.zip_with("cells", "texts", out), ""), lambda x: F.when(x.endswith("\n"), x).otherwise(F.concat(x, F.lit("\n"))))
    return F.when(F.exists(F.arrays_zip(F.col("cells").alias("c"), F.col("texts").alias("t")), lambda x: x["c"]["eligible"] & x["t"].isNotNull()), joined).otherwise(F.col("source"))


def csv_cell_segments(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """segments of the eligible cells, in row order; seg_idx is dense. No shuffle."""
    own = csv_rows(df, text_col, id_col).select("doc_id", "part", F.posexplode(F.filter("cells", lambda c: c["eligible"])).alias("seg_idx", "x"))
    return own.select("doc_id", "part", "seg_idx", F.lit("cell").alias("kind"), F.col("x.raw").alias("text"), "x.row", "x.col", "x.quoted")


def assemble_csv(df: DataFrame, translated: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text) from translated cells (doc_id, row, col, text). Documents without any keep their source as it was."""
    new = translated.groupBy("doc_id").agg(F.collect_list(F.struct("row", "col", "text")).alias("new"))
    rows = csv_rows(df, text_col, id_col).join(new, "doc_id", "left")
    # cells and their new texts in one order; a new text comes before its cell
    told = F.transform(F.coalesce("new", F.array().cast("array<struct<row:int,col:int,text:string>>")), lambda x: F.struct(x["row"].alias("row"), x["col"].alias("col"), F.lit(0).alias("k"), x["text"].alias("t")))
    both = F.sort_array(F.concat(told, F.transform("cells", lambda c: F.struct(c["row"].alias("row"), c["col"].alias("col"), F.lit(1).alias("k"), F.lit(None).cast("string").alias("t")))))
    before = lambda own, i: F.get(own, F.greatest(i - 1, F.lit(0)))
    texts = let(both, lambda own: F.transform(F.filter(F.transform(own, lambda x, i: F.struct(x["k"].alias("k"), F.when((i > 0) & (before(own, i)["k"] == 0), before(own, i)["t"]).alias("t"))), lambda x: x["k"] == 1), lambda x: x["t"]))
    return rows.withColumn("texts", texts).select("doc_id", join_cells().alias("text"))
