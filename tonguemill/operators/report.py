"""Run report: one row per file, its summary, and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tonguemill.core.shared import own_folder
from tonguemill.functions.scalars import js_round

#: Ranges of names that overall_progress numbers apart.
RANGES = 256
RESULT = ("name", "dest", "ok", "skipped", "error")


def job_results(skipped: DataFrame, done: DataFrame, failed: DataFrame) -> DataFrame:
    """results from skipped (name, dest), done (name, dest) and failed (name, error)."""
    none = F.lit(None).cast("string")
    return (
        skipped.select("name", "dest", F.lit(True).alias("ok"), F.lit(True).alias("skipped"), none.alias("error"))
        .unionByName(done.select("name", "dest", F.lit(True).alias("ok"), F.lit(False).alias("skipped"), none.alias("error")))
        .unionByName(failed.select("name", none.alias("dest"), F.lit(False).alias("ok"), F.lit(False).alias("skipped"), "error"))
    )


def job_summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if(F.col("ok") & ~F.col("skipped")).alias("translated"), F.count_if("skipped").alias("skipped"), F.count_if(~F.col("ok")).alias("failed"))


def overall_progress(files: DataFrame) -> DataFrame:
    """files (name, done, total) with percent of the job after each, in order of name.

    The files are written down once. Rows are numbered within ranges of names and the ranges' running counts added; the driver gets a row for
    each range. The bounds are literals, so a row's range is the same on every recomputation.
    """
    at = own_folder(files.sparkSession, "progress")
    files.write.mode("overwrite").parquet(at)
    files = files.sparkSession.read.schema(files.schema).parquet(at)
    few = files.where("name is not null").select("name").distinct().orderBy(F.xxhash64("name"), "name").limit(RANGES - 1)
    bounds = F.array(*[F.lit(r.name) for r in few.collect()]).cast("array<string>")
    dealt = files.withColumn("__range", F.size(F.filter(bounds, lambda x: x <= F.col("name"))))
    n, before = 0, []
    for r in sorted(dealt.groupBy("__range").count().collect()):
        before += [F.lit(r[0]), F.lit(n)]
        n += r[1]
    if not n:
        before = [F.lit(0), F.lit(0)]
    w = Window.partitionBy("__range").orderBy("name")
    part = F.when(F.col("total") > 0, F.col("done") / F.col("total")).otherwise(F.lit(0.0))
    i = (F.row_number().over(w) - 1 + F.create_map(*before)[F.col("__range")]).cast("int")
    return dealt.withColumn("i", i).withColumn("percent", js_round((F.col("i") + part) / max(n, 1) * 100).cast("int")).drop("__range")


def inbox_stats(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count("*").alias("files"), F.count_if("already_translated").alias("translated"))
