"""Configuration of a job and the formats it can read."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

# Extension, extension of the output, family, MIME type of the output.
OCTETS = "application/octet-stream"
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
PPTX = "application/vnd.openxmlformats-officedocument.presentationml.presentation"
XLSX = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"
FORMATS = (
    (".docx", ".docx", "docx", DOCX),
    (".pptx", ".pptx", "pptx", PPTX),
    (".xlsx", ".xlsx", "workbook", XLSX),
    (".pdf", ".docx", "layout", DOCX),
    (".txt", ".txt", "plain", OCTETS),
    (".md", ".md", "plain", OCTETS),
    (".csv", ".csv", "csv", OCTETS),
    (".html", ".html", "html", OCTETS),
    (".htm", ".html", "html", OCTETS),
    (".rtf", ".docx", "rtf", DOCX),
)
LANGUAGES = {"bokmal": "norsk bokmål", "nynorsk": "norsk nynorsk"}
OUTPUT_FOLDER = "oversatt"


# Schemes that Spark names otherwise than pyarrow.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def open_folder(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """pyarrow's file system and path of a folder or file that Spark names by a URI or a local path. Names are taken as they are, with
    blanks and marks that a URI would have to escape."""
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        return pyarrow.fs.LocalFileSystem(), uri
    if scheme == "file":  # Hadoop writes one slash
        return pyarrow.fs.LocalFileSystem(), "/" + rest.lstrip("/")
    authority, slash, name = rest.removeprefix("//").partition("/")
    fs, root = pyarrow.fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{authority}/")
    return fs, f"{root.rstrip('/')}{slash}{name}"


@dataclass(frozen=True)
class JobConfig:
    """A translation job. The key of a model endpoint is never part of it: executors take it from their environment."""

    in_dir: str
    out_dir: str
    target: str = "bokmal"
    skip_existing: bool = True
    model: str = ""
    max_chars: int = 7000
    max_items: int = 28
    overhead: int = 8
    max_prompt: int = 80_000


def formats(spark: SparkSession) -> DataFrame:
    """The ten formats as a table; its size is fixed, so it may be broadcast."""
    return spark.createDataFrame(list(FORMATS), "ext string, out_ext string, family string, mime string")
