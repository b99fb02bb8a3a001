"""Helpers shared by the training-data operators: table access, scratch tables in the cluster's shared folder, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_kept: dict = {}


def worker_cache(name, make):
    """What a Python worker keeps for one operator from task to task; asking for another operator's drops it, so they don't add up."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


BLANKS = b" \t\n\x0b\x0c\r"
_BLANK = np.isin(np.arange(256), np.frombuffer(BLANKS, "uint8"))
_LETTER = np.random.default_rng(20).integers(0, 2**64, 256, dtype="uint64")
_STEP, _BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
#: Bytes that are hashed at once, unless a single word is longer.
_STRETCH = 1 << 20
_powers = [np.ones(1, "uint64"), np.ones(1, "uint64")]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2**64."""
    while len(_powers[0]) < n:
        for k, base in enumerate((_STEP, _BACK)):
            _powers[k] = np.append(_powers[k], _powers[k] * np.uint64(pow(base, len(_powers[k]), 1 << 64)))
    return _powers[0][:n], _powers[1][:n]


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of k words, from the words' hashes."""
    if len(h) < k:
        return np.empty(0, "uint64")
    up, down = powers(len(h))
    sums = np.append(np.uint64(0), np.cumsum(h * up))
    return mix((sums[k:] - sums[:-k]) * down[: len(h) - k + 1])


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the words of all texts, in order; how many words each text has). Words are what bytes.split() gives.

    A word's hash is a polynomial over a random number for each byte, from running sums, so there is no loop over words.
    """
    data = np.frombuffer(b" ".join([*raw, b""]), "uint8")
    blank = _BLANK[data]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    edges = np.append(0, edges) if len(data) and not blank[0] else edges
    start, end = edges[::2], edges[1::2]
    out, i = np.empty(len(start), "uint64"), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _STRETCH, "right")))
        a, b = int(start[i]), int(end[j - 1])
        up, down = powers(b - a)
        sums = np.append(np.uint64(0), np.cumsum(_LETTER[data[a:b]] * up))
        out[i:j] = (sums[end[i:j] - a] - sums[start[i:j] - a]) * down[start[i:j] - a]
        i = j
    bounds = np.append(0, np.cumsum(np.fromiter(map(len, raw), "int64", len(raw)) + 1))
    return mix(out), np.diff(np.searchsorted(start, bounds))


def utf8(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ..., as many as counts[0], then those from first[1], and so on."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + counts, counts)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def row_key(*cols: str) -> Column:
    """Identity of a row by its content, the same on every recomputation; equal rows share it."""
    return F.xxhash64(*[F.col(c) for c in cols])


_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Where that is unset, a temporary one on one machine (tests), and
    an error on a cluster."""
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at and (known := context.getCheckpointDir()):
        at = known.rsplit("/", 1)[0]
    if not at:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = _own_dir.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="spark-")
        _own_dir[context.applicationId] = at
    return at.rstrip("/")


#: Whether Spark removes the shuffle files of a query when it has ended, instead of when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables that cut the lineage: written as Parquet to the shared folder, so they survive a lost executor and are read column by column.

    What is left of them goes when the driver ends, as results may read them until then.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.known = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", False

    def _path(self, label: str = ""):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{label}" if label else self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def save(self, df: DataFrame, label: str) -> DataFrame:
        if not self.known:
            fs, path = self._path()
            fs.mkdirs(path)
            fs.deleteOnExit(path)
            self.known = True
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")  # what the table was made from isn't needed any more
        try:
            df.write.mode("overwrite").parquet(f"{self.root}/{label}")
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{label}")

    def drop(self, *labels: str) -> None:
        """Removes tables that no later step reads."""
        for label in labels:
            fs, path = self._path(label)
            fs.delete(path, True)


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, label: str = "cc") -> DataFrame:
    """(node, component) for every node of edges(a, b): the smallest node that links reach.

    Alternating large-star and small-star rounds over distinct edges; each round is a shuffle with partial aggregation and is
    written to the shared folder. Nothing but the number of changed edges reaches the driver.
    """
    cur = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{label}0")
    round_, before = 0, None
    while True:
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        # every larger neighbour of a, and every smaller one with a itself, moves to the least of a's neighbourhood
        big = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = big.groupBy("a").agg(F.min("b").alias("m"))
        nxt = big.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        nxt = nxt.where("a <> b").distinct()
        round_ += 1
        nxt = scratch.save(nxt, f"{label}{round_}")
        after = nxt.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if after == before:
            break
        scratch.drop(f"{label}{round_ - 1}")
        cur, before = nxt, after
    scratch.drop(f"{label}{round_ - 1}")
    return nxt.select(F.col("a").alias("node"), F.col("b").alias("component"))
