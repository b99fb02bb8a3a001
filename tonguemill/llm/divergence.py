"""Source divergence audit: how far a language's sources are from each other, and which terms set a source apart from its language.

A term's weight in a group is p = 1 + floor(10**9 (count + 2) / (N + 2 V)), and two weights differ by f = floor((p - q)**2 / (p + q)).
Where p > q, f never falls when the group's count rises or the language's count falls. So a term that k others beat or equal in both
counts, and in UTF-8 order, has k others before it in the ranking. Tasks keep the terms that fewer than k others dominate (a skyband),
skybands of several tasks merge into one, and only what is left is weighed and ranked.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tonguemill.llm.common import Scratch, table

#: Terms reported for a group, and documents of its language that a term must stand in.
TOP, LEAST_DOCS = 10, 10
SCALE = 1_000_000_000
#: Sources of a block of the matrix of pairs, terms that one task meets with a block pair, and rows of them weighed at once, about.
BLOCK, CHUNK, SLICE = 128, 20_000, 512
#: Terms that a task counts before it hands the counts on, bytes of a text that are split at once, rows that a task takes the skybands of
#: at once, and parts in which the skybands of tasks merge first.
FLUSH, STRETCH, HELD, FAN = 200_000, 1 << 22, 500_000, 16
#: A-Z to a-z; other ASCII that is no letter to a blank; bytes of non-ASCII characters stay.
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def terms(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in lists of bounded size."""
    folded, at = raw.translate(_FOLD), 0
    while at < len(folded):
        end = len(folded) if len(folded) - at <= STRETCH else folded.find(b" ", at + STRETCH)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, d): occurrences and documents of terms, summed over many documents of a partition."""
    seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def give() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in seen.items():
            if n:
                own = list(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array([source] * len(own), pa.string()), pa.array(own, pa.binary()), pa.array(n.values(), pa.int64()), pa.array([d[t] for t in own], pa.int64())], names=["lang", "source", "term", "n", "d"])

    for batch in batches:
        for lang, source, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n, d = seen.setdefault((lang, source), (Counter(), Counter()))
            held -= len(n)
            once: set[bytes] = set()
            for own in terms(raw):
                n.update(own)
                once.update(own)
            d.update(once)
            held += len(n)
            if held > FLUSH:
                yield from give()
                seen, held = {}, 0
    yield from give()


def skyband(n: np.ndarray, total: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Indices of the rows that fewer than k others dominate: with n as high, total as low and rank as early.

    In order of (n falling, total, rank) only earlier rows can dominate a row, and of its dominators the first k are in the skyband
    themselves, so each row is held against the skyband so far.
    """
    order = np.lexsort((rank, total, -n))
    kept, t, r, m = np.empty(len(n), "int64"), np.empty(len(n), "int64"), np.empty(len(n), "int64"), 0
    for a in range(0, len(order), SLICE):
        own, before = order[a : a + SLICE], m
        over = ((t[:m, None] <= total[own]) & (r[:m, None] <= rank[own])).sum(0)
        some = over < k
        for i, x, y, n_over in zip(own[some].tolist(), total[own[some]].tolist(), rank[own[some]].tolist(), over[some].tolist(), strict=True):
            if n_over + np.count_nonzero((t[before:m] <= x) & (r[before:m] <= y)) < k:
                kept[m], t[m], r[m] = i, x, y
                m += 1
    return kept[:m]


BANDS = "lang string, source string, salt int, n long, total long, term binary"


def _band(rows: pa.Table, k: int) -> pa.Table:
    """The skyband of each group (lang, source) of rows (..., n, total, term)."""
    rank = np.empty(rows.num_rows, "int64")
    rank[pc.sort_indices(rows["term"]).to_numpy()] = np.arange(len(rank))
    n, total = rows["n"].to_numpy(), rows["total"].to_numpy()
    own = [pc.dictionary_encode(rows[c].combine_chunks()).indices.to_numpy(zero_copy_only=False).astype("int64") for c in ("lang", "source")]
    code = own[0] * (own[1].max(initial=0) + 1) + own[1]
    order = np.argsort(code, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(code[order])) + 1)
    return rows.take(pa.array(np.concatenate([g[skyband(n[g], total[g], rank[g], k)] for g in groups])))


def _local(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The skyband of each group's rows (lang, source, n, total, term) in this task, HELD rows at a time."""
    salt = TaskContext.get().partitionId() % FAN

    def give(rows: pa.Table) -> list[pa.RecordBatch]:
        return rows.append_column("salt", pa.array(np.full(rows.num_rows, salt, "int32"))).select(["lang", "source", "salt", "n", "total", "term"]).to_batches()

    held: list[pa.Table] = []
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) > HELD:
            held = [_band(pa.concat_tables(held), k)]
            if held[0].num_rows > HELD // 2:  # so many groups that they fill it
                yield from give(held.pop())
    if sum(t.num_rows for t in held):
        yield from give(_band(pa.concat_tables(held), k))


def weight(count: str, size: str) -> Column:
    """p of a count in a group of N + 2 V = size; decimals keep it exact."""
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(10, 0)) * CAST({count} + 2 AS DECIMAL(20, 0))) div CAST({size} AS DECIMAL(20, 0))")


def weights(count: np.ndarray, size: np.ndarray) -> np.ndarray:
    """weight() in numpy: long division by steps of 1000, exact for counts and sizes below 9 * 10**15."""
    rest, out = count + 2, np.zeros_like(count + size)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // size
        rest = rest % size
    return 1 + out


def differ(p, q):
    return (p - q) * (p - q) // (p + q)


_PAIRS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _pairs(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Sums of f over the terms of `left` (cells: a list for each term) for the sources of two blocks; those that stand nowhere in `right`'s
    blocks are alike and come as V times the f of two zero counts, with the first part."""
    lang, a_block, b_block, salt = (k.as_py() for k in key)
    names = right["source"].to_pylist()
    where = {s: i for i, s in enumerate(names)}
    size, block, v = (right[c].to_numpy() for c in ("size", "block", "v"))
    a, b = np.flatnonzero(block == a_block), np.flatnonzero(block == b_block)
    total = np.zeros((len(a), len(b)), "int64")
    if v[0]:
        zero = weights(np.zeros_like(size), size)
        none = differ(zero[a][:, None], zero[b])
        total += none * v[0] * (salt == 0)
        for begin in range(0, left.num_rows, SLICE):
            cells = left["cells"].slice(begin, SLICE).combine_chunks()
            own = cells.flatten()
            row = np.repeat(np.arange(len(cells)), cells.value_lengths().to_numpy())
            at = np.array([where[s] for s in own.field("source").to_pylist()], "int64")
            p = np.repeat(zero[None], len(cells), 0)
            p[row, at] = weights(own.field("n").to_numpy(zero_copy_only=False), size[at])
            for i, x in enumerate(a):
                total[i] += differ(p[:, x][:, None], p[:, b]).sum(0) - none[i] * len(cells)
    i, j = (x.ravel() for x in np.indices(total.shape))
    some = a[i] != b[j]
    source, item, value = a[i][some], b[j][some], total[i, j][some]
    if a_block != b_block:
        source, item, value = np.append(source, item), np.append(item, source), np.append(value, value)
    own = pa.array(names, pa.string())
    return pa.Table.from_arrays([pa.array([lang] * len(value), pa.string()), own.take(pa.array(source)), own.take(pa.array(item)), pa.array(value, pa.int64())], schema=_PAIRS)


def audit_sources(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", top: int = TOP, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part `pair`: the divergence of a group from each other source of its language, all of them. Part `term`: the `top` terms that stand
    out in a group against its language. Terms in fewer than least_docs documents of the language are left out. Null text, lang and source
    count as empty; a group without terms has pairs and no terms, a language without kept terms pairs of value 0; repeated rows count each;
    ties go by UTF-8 order of the item; an empty table gives none. Only the three columns are read, whatever the names of others.

    Tasks count their documents' terms in bounded tables, so what is shuffled are counts, by language and term: one row for each source and
    task. The vector of a term holds a number for each source of its language that has it. Pairs are summed over parts of the terms,
    for blocks of sources, so neither a large source nor many sources meet in one task.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).cast("binary").alias("text"))
    counted = rows.mapInArrow(_count, "lang string, source string, term binary, n long, d long").repartition("lang", "term")
    cells = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    vectors = cells.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("d").alias("d"), F.collect_list(F.struct("source", "n")).alias("cells"))
    vectors = scratch.save(vectors.where(F.col("d") >= least_docs).drop("d"), "vectors")

    sizes = vectors.select("lang", F.explode("cells").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("own"))
    langs = vectors.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("all"))
    groups = rows.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    v, own, every = (F.coalesce(c, F.lit(0)) for c in ("v", "own", "all"))
    groups = scratch.save(groups.select("lang", "source", v.alias("v"), (own + 2 * v).alias("size"), (every + 2 * v).alias("lang_size")), "groups")

    loose = vectors.select("lang", "term", "total", F.explode("cells").alias("c")).select("lang", "c.source", "c.n", "total", "term")
    bands = loose.mapInArrow(lambda it: _local(it, top), BANDS)
    bands = bands.groupBy("lang", "source", "salt").applyInArrow(lambda t: _band(t, top), BANDS)
    bands = bands.groupBy("lang", "source").applyInArrow(lambda t: _band(t, top), BANDS)
    told = bands.join(groups, ["lang", "source"]).withColumn("p", weight("n", "size")).withColumn("q", weight("total", "lang_size")).where("p > q")
    told = told.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))

    parts = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.ceil(F.greatest(F.max("v"), F.lit(1)) / CHUNK).alias("salts"))
    block = lambda source: F.pmod(F.xxhash64(source), "blocks").cast("int")
    numbers = lambda a, b: F.sequence(F.lit(a) if isinstance(a, int) else a, b.cast("int") - 1)
    placed = groups.join(parts, "lang").withColumn("block", block(F.col("source"))).withColumn("other", F.explode(numbers(0, F.col("blocks")))).withColumn("salt", F.explode(numbers(0, F.col("salts"))))
    placed = placed.select("lang", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "salt", "block", "source", "size", "v")
    dealt = vectors.join(parts, "lang").withColumn("salt", F.pmod(F.xxhash64("term"), "salts").cast("int")).withColumn("a", F.explode(numbers(0, F.col("blocks")))).withColumn("b", F.explode(numbers(F.col("a"), F.col("blocks"))))
    dealt = dealt.withColumn("cells", F.filter("cells", lambda c: block(c["source"]).isin(F.col("a"), F.col("b")))).where(F.size("cells") > 0).select("lang", "a", "b", "salt", "cells")
    by = ("lang", "a", "b", "salt")
    sums = dealt.groupBy(*by).cogroup(placed.groupBy(*by)).applyInArrow(_pairs, "lang string, source string, item string, value long")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pairs.unionByName(told).withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"))


SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS (SELECT rid, lang, source, unnest(ts) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
cells AS (SELECT t.lang, source, term, count(*) AS n FROM t SEMI JOIN kept ON t.lang = kept.lang AND t.term = kept.term GROUP BY t.lang, source, term),
g AS (SELECT DISTINCT lang, source FROM docs),
v AS (SELECT lang, count(*) AS v, sum(total) AS every FROM kept GROUP BY lang),
sizes AS (SELECT lang, source, sum(n) AS own FROM cells GROUP BY lang, source),
p AS (SELECT g.lang, g.source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (coalesce(own, 0) + 2 * v) AS p,
        1 + (1000000000::HUGEINT * (total + 2)) // (every + 2 * v) AS q
      FROM (SELECT * FROM g LEFT JOIN sizes USING (lang, source)) g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN cells USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.other = b.source),
told AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM told)) WHERE part = 'pair' OR rank <= 10
"""
