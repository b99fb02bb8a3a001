"""Language identification by error-correcting output codes.

Every language has a codeword of a Hadamard matrix. For each bit a binary byte-trigram classifier tells the languages with a 1 from
those with a 0; a text's language is the codeword of least weighted logistic loss against the bits' margins. Two codewords of nearly
the same loss make the answer ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonguemill.llm.common import table, worker_cache

#: Labelled rows for each language that the classifier is fitted on, about; drawn by a hash of doc_id. The README documents it.
SAMPLE_PER_LANG = 4000
BUCKETS = 1 << 16
SHARPNESS = 4.0
#: A best codeword that is not this much better than the second, in probability, is ambiguous.
AMBIGUOUS = 0.2
#: A-Z to a-z; other ASCII that is no letter to a blank; bytes of non-ASCII characters stay.
_FOLD = np.array([i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256)], "uint32")


def _trigrams(data: np.ndarray) -> np.ndarray:
    b = _FOLD[data]
    return ((b[:-2] * np.uint32(0x3D4D51CB) + b[1:-1] * np.uint32(0x2C1B3C6D) + b[2:] * np.uint32(0x297A2D39)) * np.uint32(0x9E3779B1)) >> np.uint32(16)


def _parts(col: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of stretches of rows of about `most` bytes; a longer text is a stretch of its own."""
    col = col.cast(pa.large_binary())
    if not len(col):
        return
    ends = np.frombuffer(col.buffers()[1], "int64")[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", "uint8")
    a = 0
    while a < len(col):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, "right")) - 1)
        yield a, b, data[ends[a] : ends[b]], ends[a : b + 1] - ends[a]
        a = b


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) sums of a partition of (lang, text)."""
    total: dict[str, np.ndarray] = {}
    worker_cache("langid", lambda: None)
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for a, b, data, ends in _parts(batch.column(1)):
            for i in range(a, b):
                own = data[ends[i - a] : ends[i - a + 1]]
                if len(own) > 2:
                    total.setdefault(langs[i], np.zeros(BUCKETS, "int64"))
                    total[langs[i]] += np.bincount(_trigrams(own), minlength=BUCKETS)
    for lang, n in total.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype("int32")), pa.array(n[at])], names=["lang", "bucket", "n"])


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    code: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # buckets x bits
    trust: np.ndarray  # bits

    def predict(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, its probability, and whether it is ambiguous."""
        loss = (self.trust * np.logaddexp(0, -SHARPNESS * self.code[None] * margins[:, None])).sum(2)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        top = np.sort(p, 1)
        gap = top[:, -1] - (top[:, -2] if len(self.langs) > 1 else 0)
        return best, p[np.arange(len(p)), best], gap < AMBIGUOUS


def codewords(n: int) -> np.ndarray:
    """n rows of a Hadamard matrix without its constant column: any two differ in half of the bits."""
    h = np.ones((1, 1))
    while len(h) < max(4, 2 * n):
        h = np.block([[h, h], [h, -h]])
    rows = h[1 : n + 1, 1:]
    return rows[:, np.abs(rows.sum(0)) < n] if n > 1 else rows


def is_held_out(doc_id):
    """crc32 of doc_id as text is a multiple of 5; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> Model:
    """Fits on text and lang of a bounded sample of the rows that aren't held out.

    The driver gets one row for each language, then at most BUCKETS counts for each; texts stay on the executors.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model((), np.zeros((0, 1)), np.zeros((BUCKETS, 1)), np.ones(1))
    share = F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1.0, per_lang / n))])
    drawn = rows.where((F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5) < share[F.col("lang")]).select("lang", "text").repartition(8)
    sums = drawn.mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = tuple(sorted(sizes))
    counts = np.zeros((len(langs), BUCKETS))
    counts[[langs.index(x) for x in sums.lang], sums.bucket] = sums.n
    p = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
    code = codewords(len(langs))
    with np.errstate(divide="ignore", invalid="ignore"):
        ones, zeros = ((code > 0).T @ p) / (code > 0).sum(0)[:, None], ((code < 0).T @ p) / (code < 0).sum(0)[:, None]
        weights = np.nan_to_num(np.log(ones / zeros)).T
    expected = p @ weights * code  # languages x bits: the margin a text of the language should have
    scale = np.abs(expected).mean(0)
    weights = weights / np.where(scale > 0, scale, 1)
    trust = np.maximum(expected.min(0), 0) / np.where(scale > 0, scale, 1) + 0.1
    return Model(langs, code, weights.astype("float32"), trust / trust.sum() * 3)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and ambiguous; `und`, 0 and true for null texts and texts without a letter, or when nothing was learned.

    The model (BUCKETS x bits, fixed by the number of languages) goes to the executors; texts are scored whole, row by row, by
    their bytes alone. Columns of the input with these names are replaced.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["lang_pred string, score double, ambiguous boolean"])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        worker_cache("langid", lambda: None)  # what other operators have left in this worker goes
        for batch in batches:
            text, letter = batch.column(len(keep)), np.array(batch.column(len(keep) + 1).to_pylist(), bool)
            margins = np.zeros((batch.num_rows, m.weights.shape[1]))
            for a, b, data, ends in _parts(text):
                if len(data) < 3:
                    continue
                t = m.weights[_trigrams(data)]
                for i in range(a, b):
                    lo, hi = ends[i - a], ends[i - a + 1] - 2
                    if hi > lo:
                        margins[i] = t[lo:hi].mean(0, dtype="float64")
            names, score, unsure = np.array(["und"] * batch.num_rows, object), np.zeros(batch.num_rows), np.ones(batch.num_rows, bool)
            if m.langs:
                best, p, close = m.predict(margins)
                names[letter] = np.array(m.langs, object)[best][letter]
                score, unsure = np.where(letter, p, 0.0), close | ~letter
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(names, pa.string()), pa.array(score), pa.array(unsure)], names=[*keep, "lang_pred", "score", "ambiguous"])

    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return docs.select(*keep, F.col(text_col).alias("__text"), letter.alias("__letter")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    named = identify(docs.select("doc_id", "text"), fit(docs))
    return named.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
