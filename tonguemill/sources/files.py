"""Folders of documents: scan, manifest, routing, destinations, skipping, decoding."""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import BinaryType

from tonguemill.core.config import FORMATS, OUTPUT_FOLDER, formats, open_folder
from tonguemill.core.shared import hadoop_path, own_folder
from tonguemill.functions.scalars import ext_of, output_name

NO_FOLDER = "Inn-mappen finnes ikke."
UNSUPPORTED = "Filtypen {} støttes ikke."
FILES = "path string, modificationTime timestamp, length long, content binary"


#: Bytes of contents that are held at once, folders that one task lists, and rows of a block of a listing.
HELD, FOLDERS, BLOCK = 32 << 20, 32, 10_000
_LISTED = pa.schema([("path", pa.string()), ("folder", pa.bool_()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64())])
LISTED = "path string, folder boolean, modificationTime timestamp, length long"


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folders (path) to what is right in them. Names that begin with a dot and links are left out, and folders that can't be read."""
    for batch in batches:
        for at in batch.column(0).to_pylist():
            fs, path = open_folder(at)
            try:
                found = fs.get_file_info(pyarrow.fs.FileSelector(path, allow_not_found=True))
            except OSError:
                continue
            local = isinstance(fs, pyarrow.fs.LocalFileSystem)
            rows = ((f"{at.rstrip('/')}/{i.base_name}", i.type == pyarrow.fs.FileType.Directory, i.mtime, i.size) for i in found if i.type != pyarrow.fs.FileType.NotFound and not i.base_name.startswith(".") and not (local and os.path.islink(i.path)))
            while part := list(itertools.islice(rows, BLOCK)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), _LISTED.types, strict=True)], schema=_LISTED)


def list_files(spark: SparkSession, in_dir: str, leave_out: str = "") -> DataFrame:
    """(path, modificationTime, length) of all files below a folder but those below a name that begins with a dot; `leave_out` is a pattern of
    folders (paths) that aren't entered.

    Level by level: tasks list the folders that were found last and write down what is in them. The driver gets the number of folders of
    each level, never a name, so a folder may have any number of files.
    """
    fs, path = hadoop_path(spark, in_dir)
    at, level = own_folder(spark, "listing"), 0
    frontier = spark.createDataFrame([(fs.makeQualified(path).toString().rstrip("/"),)], "path string")
    n = 1
    while n:
        frontier.repartition(max(1, -(-n // FOLDERS))).mapInArrow(_entries, LISTED).write.parquet(f"{at}/level={level}")
        found = spark.read.schema(LISTED).parquet(f"{at}/level={level}")
        frontier = found.where("folder").select("path")
        frontier = frontier.where(~F.col("path").rlike(leave_out)) if leave_out else frontier
        n, level = frontier.count(), level + 1
    return spark.read.schema(f"{LISTED}, level int").parquet(at).where("not folder").select("path", "modificationTime", "length")


@F.pandas_udf(BinaryType())
def contents(paths: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Contents, some files at a time, however many paths come at once."""
    for series in paths:
        held, size = [], 0
        for at in series:
            fs, path = open_folder(at)
            with fs.open_input_stream(path, compression=None) as f:
                held.append(f.read())
            size += len(held[-1])
            if size > HELD:
                yield pd.Series(held, dtype=object)
                held, size = [], 0
        if held or not len(series):
            yield pd.Series(held, dtype=object)


def relative_to(in_dir: str, column: str = "path"):
    """Name below the folder, with neither scheme nor host."""
    bare = lambda c: F.regexp_replace(c, r"\A[a-zA-Z][a-zA-Z0-9+.-]*:(?://[^/]*)?", "")
    root = F.regexp_replace(bare(F.lit(in_dir)), r"/+\z", "")
    return F.substr(bare(F.col(column)), F.length(root) + 2)


def keep_documents(files: DataFrame, in_dir: str, out_dir: str | None = None) -> DataFrame:
    """files with name and ext: supported types, no name or folder that begins with a dot, nothing below an output folder."""
    rows = files.withColumn("name", relative_to(in_dir)).withColumn("ext", ext_of(F.col("name")))
    hidden = F.col("name").rlike(r"(?:\A|/)\.")
    output = F.lower("name").rlike(rf"(?:\A|/){OUTPUT_FOLDER}/")
    rows = rows.where(F.col("ext").isin([f[0] for f in FORMATS]) & ~hidden & ~output)
    if out_dir and out_dir.rstrip("/").startswith(in_dir.rstrip("/") + "/"):
        inner = out_dir.rstrip("/")[len(in_dir.rstrip("/")) + 1 :]
        rows = rows.where(~F.startswith("name", F.lit(inner + "/")))
    return rows


def scan_documents(spark: SparkSession, in_dir: str, out_dir: str | None = None) -> DataFrame:
    """(path, length, content, name, ext) of every document below the folder; bytes are read only where content is used."""
    out = f"|\\A{re.escape(_qualified(spark, out_dir))}\\z" if out_dir else ""
    files = list_files(spark, in_dir, rf"(?i)/{OUTPUT_FOLDER}\z{out}").select("*", contents("path").alias("content"))
    return keep_documents(files, in_dir, out_dir)


def _qualified(spark: SparkSession, at: str) -> str:
    fs, path = hadoop_path(spark, at)
    return fs.makeQualified(path).toString().rstrip("/")


def route_formats(manifest: DataFrame) -> DataFrame:
    """manifest with family, out_ext, mime, status and error; unknown types are errors. The ten formats are broadcast."""
    routed = manifest.drop("out_ext", "family", "mime").join(F.broadcast(formats(manifest.sparkSession)), "ext", "left")
    unknown = F.col("family").isNull()
    return routed.withColumn("status", F.when(unknown, "error").otherwise("ok")).withColumn("error", F.when(unknown, F.format_string(UNSUPPORTED.replace("{}", "%s"), "ext")))


def with_dest(manifest: DataFrame, out_dir: str) -> DataFrame:
    """manifest with dest: the name below the output folder, its extension replaced. A name without stem keeps its dot."""
    stem = F.regexp_replace("name", r"(?<=[^/])\.[^./]*\z", "")
    return manifest.withColumn("dest", F.when(F.col("out_ext").isNotNull(), F.concat(F.lit(out_dir.rstrip("/") + "/"), stem, "out_ext")))


def build_manifest(files: DataFrame, existing: DataFrame, out_dir: str) -> DataFrame:
    """(path, name, ext, bytes, family, dest, already_translated) from scanned files and existing outputs (dest)."""
    routed = with_dest(route_formats(files), out_dir)
    there = existing.select("dest").distinct().withColumn("there", F.lit(True))
    return routed.join(there, "dest", "left").select("path", "name", "ext", F.col("length").alias("bytes"), "family", "dest", F.coalesce("there", F.lit(False)).alias("already_translated"))


def list_outputs(spark: SparkSession, out_dir: str) -> DataFrame:
    """(dest) of what the output folder holds; empty if there is none."""
    fs, path = hadoop_path(spark, out_dir)
    if not fs.exists(path):
        return spark.createDataFrame([], "dest string")
    return list_files(spark, out_dir).select(F.concat(F.lit(out_dir.rstrip("/") + "/"), relative_to(out_dir)).alias("dest"))


def scan_folder(spark: SparkSession, in_dir: str, out_dir: str) -> tuple[DataFrame | None, str | None]:
    """(manifest, None), or (None, error) for a missing folder."""
    fs, path = hadoop_path(spark, in_dir)
    if not fs.exists(path):
        return None, NO_FOLDER
    return build_manifest(scan_documents(spark, in_dir, out_dir), list_outputs(spark, out_dir), out_dir), None


def skip_existing(manifest: DataFrame, existing: DataFrame, enabled: bool = True) -> tuple[DataFrame, DataFrame]:
    """(to do, skipped)."""
    if not enabled:
        return manifest, manifest.where(F.lit(False))
    return manifest.join(existing, "dest", "left_anti"), manifest.join(existing.select("dest"), "dest", "left_semi")


def resolve_dest_collisions(results: DataFrame, skip: bool = True) -> DataFrame:
    """Of successful results (name, dest, ok) that share a dest the one whose output stays: the first in order of name when existing
    outputs are skipped, else the last."""
    by = F.collate("name", "nb")
    w = Window.partitionBy("dest").orderBy(by.asc() if skip else by.desc(), F.col("name").asc() if skip else F.col("name").desc())
    return results.where("ok").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def order_manifest(manifest: DataFrame) -> DataFrame:
    """In Norwegian order of path, with rank: a file's place in its folder.

    Paths are dealt by ranges of that order and written down, so that the ranges stay as they are; places are counted within a range, and what
    the folder has in earlier ranges is added. A folder of any number of files is spread over tasks.
    """
    spark, by = manifest.sparkSession, (F.collate("path", "nb"), F.col("path"))
    at = own_folder(spark, "order")
    dealt = manifest.withColumn("__folder", F.coalesce(F.regexp_extract("path", r"\A(.*/)", 1), F.lit("\0"))).repartitionByRange("__folder", *by).withColumn("__range", F.spark_partition_id())
    dealt.write.mode("overwrite").parquet(at)
    rows = spark.read.schema(dealt.schema).parquet(at)
    earlier = Window.partitionBy("__folder").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("__folder", "__range").agg(F.count("*").alias("n")).select("__folder", "__range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__folder", "__range").orderBy(*by))
    ranked = rows.withColumn("rank", place).join(before, ["__folder", "__range"]).withColumn("rank", (F.col("rank") + F.col("__before")).cast("int"))
    return ranked.drop("__folder", "__range", "__before").orderBy(*by)


def decode_text(files: DataFrame, csv: bool = False) -> DataFrame:
    """files with text: UTF-8, bad bytes as U+FFFD; CSV loses a leading byte order mark."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return files.withColumn("text", F.regexp_replace(text, "\\A\ufeff", "") if csv else text)


def translate_files(files: DataFrame) -> DataFrame:
    """Uploads (name, content) as routed files with their output's name; nothing is skipped."""
    routed = route_formats(files.withColumn("ext", ext_of(F.col("name"))))
    return routed.withColumn("out_name", F.when(F.col("out_ext").isNotNull(), output_name(F.col("name"), F.col("out_ext"))))
