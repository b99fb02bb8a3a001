"""Near-duplicate embeddings by an inverted multi-index.

Each half of the unit vectors has a codebook of its own; the product of both is a grid of cells. A vector visits cells in the order
of the multi-sequence algorithm, nearest first, as many as reach the target recall for pairs at the threshold; what it meets there
is verified by cosine in double precision.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonguemill.llm.common import Scratch, components, table

COSINE, RECALL = 0.98, 0.999
#: Distinct vectors that codebooks and the number of visits are fitted on, at most; drawn by a hash. The README documents it.
SAMPLE = 10_000
#: Vectors of a label that a cell should hold, about, and rows of a cell that one task compares at once.
CELL, BLOCK = 400, 4096
#: Codes of a half for labels of a few dozen vectors or more, at least, and sample vectors for each code, at least.
FEW, LEAST_CODES, PER_CODE = 48, 4, 4


def unit(rows: list, dim: int) -> np.ndarray:
    """Unit vectors in double precision, padded with zeros."""
    out = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    out /= np.abs(out).max(1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _distances(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ codes.T + (codes * codes).sum(1), 0)


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means centres from a fixed start."""
    rng = np.random.default_rng(7)
    codes = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = _distances(x, codes).argmin(1)
        for j in range(len(codes)):
            if (own := near == j).any():
                codes[j] = x[own].mean(0)
    return codes


def multi_sequence(a: np.ndarray, b: np.ndarray, visits: int) -> list[int]:
    """The cells (i * len(b) + j) of least a[i] + b[j], in order, without looking at the whole grid."""
    oa, ob = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    heap, pushed, out = [(a[oa[0]] + b[ob[0]], 0, 0)], {(0, 0)}, []
    while heap and len(out) < visits:
        _, i, j = heapq.heappop(heap)
        out.append(int(oa[i]) * len(b) + int(ob[j]))
        for p in ((i + 1, j), (i, j + 1)):
            if p[0] < len(a) and p[1] < len(b) and p not in pushed:
                pushed.add(p)
                heapq.heappush(heap, (a[oa[p[0]]] + b[ob[p[1]]], *p))
    return out


@dataclass(frozen=True)
class MultiIndex:
    dim: int
    left: np.ndarray
    right: np.ndarray
    visits: int

    def cells(self, x: np.ndarray, visits: int | None = None) -> np.ndarray:
        """Cells of unit vectors in the order of visits; the first is a vector's own."""
        h, n = self.dim // 2, min(visits or self.visits, len(self.left) * len(self.right))
        da, db = _distances(x[:, :h], self.left), _distances(x[:, h:], self.right)
        return np.array([multi_sequence(a, b, n) for a, b in zip(da, db, strict=True)], "int64").reshape(len(x), n)

    def rank(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How many cells each vector visits before the one given for it."""
        h = self.dim // 2
        da, db = _distances(x[:, :h], self.left), np.sort(raw := _distances(x[:, h:], self.right), axis=1)
        i, j = cells // len(self.right), cells % len(self.right)
        total = da[np.arange(len(x)), i] + raw[np.arange(len(x)), j]
        return np.array([np.searchsorted(b, t - a, "left").sum() for a, b, t in zip(da, db, total, strict=True)])


def fit(x: np.ndarray, hottest: int, cosine: float = COSINE, recall: float = RECALL) -> MultiIndex:
    """Codebooks for a label of `hottest` distinct vectors, and the visits that find `recall` of the sample's vectors when each is
    turned to the threshold's angle in a random direction. Either of a pair may visit the other's cell. The grid grows with the label up
    to (len(x) / PER_CODE)**2 cells, 6 million for a full sample; larger cells are split in blocks, all of which are met."""
    least = LEAST_CODES if hottest >= FEW else 1
    k = int(np.clip(round((hottest / CELL) ** 0.5), least, max(least, len(x) // PER_CODE)))
    h = x.shape[1] // 2
    index = MultiIndex(x.shape[1], codebook(x[:, :h].copy(), k), codebook(x[:, h:].copy(), k), 1)
    most = len(index.left) * len(index.right)
    if most == 1 or x.shape[1] < 2:
        return index
    rng = np.random.default_rng(11)
    own = x[rng.choice(len(x), min(len(x), 1000), replace=False)]
    side = rng.normal(size=own.shape)
    side -= (side * own).sum(1, keepdims=True) * own
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    turned = cosine * own + (1 - cosine**2) ** 0.5 * side
    rank = np.minimum(index.rank(own, index.cells(turned)[:, 0]), index.rank(turned, index.cells(own)[:, 0]))
    return MultiIndex(index.dim, index.left, index.right, int(np.sort(rank)[min(len(rank) - 1, int(recall * len(rank)))]) + 1)


def _forest(q: np.ndarray, x: np.ndarray, qid: np.ndarray, xid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what the links (q[i], x[i]) join, at most one for each vector."""
    ids, at = np.unique(np.concatenate([qid[q], xid[x]]), return_inverse=True)
    a, b = at[: len(q)], at[len(q) :]
    label = np.arange(len(ids))
    while True:
        least = label.copy()
        np.minimum.at(least, a, label[b])
        np.minimum.at(least, b, label[a])
        least = least[least]
        if (least == label).all():
            break
        label = least
    rest = label != np.arange(len(ids))
    return ids[rest], ids[label[rest]]


def _compare(batches: Iterator[pa.RecordBatch], dim: int, cosine: float, n_visits: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (gkey, probe): first those a cell's block holds, with their visits, then those that visit it, without. Gives
    (cid, links, other)."""

    def give(cid, links, other) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.array(links, pa.int64()), pa.array(other, pa.int64())], names=["cid", "links", "other"])

    def meet(held, asks) -> Iterator[pa.RecordBatch]:
        hid, hw, hcell, hvisits, hv = held
        qid, qw, qcell, _, qv = asks
        q, x = np.nonzero(qv @ hv.T >= cosine)
        ok = qid[q] != hid[x]
        q, x = q[ok], x[ok]
        if not len(q):
            return
        # a pair is counted for both by the visit of one side: where both visit, each side counts its own
        back = ~(hvisits[x] == qcell[q][:, None]).any(1)
        yield give(np.concatenate([qid[q], hid[x[back]]]), np.concatenate([hw[x], qw[q[back]]]), [None] * (len(q) + int(back.sum()))) if len(q) < 4096 else give(*_summed(qid, hid, hw, qw, q, x, back))
        a, b = _forest(q, x, qid, hid)
        yield give(a, np.zeros(len(a), "int64"), b)

    def columns(batch: pa.RecordBatch):
        own = [np.asarray(batch.column(i)) for i in range(5)]
        held = own[1] == 0
        visits = np.full((batch.num_rows, n_visits), -1)
        visits[held] = np.asarray(batch.column(5).flatten()).reshape(int(held.sum()), n_visits)
        return own, visits, unit(batch.column(6).to_pylist(), dim)

    held, key = None, None
    for whole in batches:
        for a in range(0, whole.num_rows, 1024):
            batch = whole.slice(a, min(1024, whole.num_rows - a))
            (gkey, probe, cid, w, cell), visits, v = columns(batch)
            group = np.flatnonzero(np.diff(gkey) != 0) + 1
            for s, e in zip([0, *group.tolist()], [*group.tolist(), len(gkey)], strict=True):
                if gkey[s] != key:
                    held, key = None, gkey[s]
                cut = s + int((probe[s:e] == 0).sum())
                part = lambda i, j: (cid[i:j], w[i:j], cell[i:j], visits[i:j], v[i:j])
                if cut > s:
                    held = part(s, cut) if held is None else tuple(np.concatenate(p) for p in zip(held, part(s, cut), strict=True))
                if cut < e and held is not None:
                    yield from meet(held, part(cut, e))


def _summed(qid, hid, hw, qw, q, x, back):
    ids, at = np.unique(np.concatenate([qid[q], hid[x[back]]]), return_inverse=True)
    n = np.bincount(at, np.concatenate([hw[x], qw[q[back]]]), len(ids)).astype("int64")
    return ids, n, [None] * len(ids)


def link_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """(id, n_links, component_id, kept) for each row.

    Only rows of equal, non-null label and equal dimension are compared. Vectors that are null, empty, zero or hold null or
    non-finite components, and those without label, link with nothing; an empty table gives none. Equal vectors of a label are one
    class, told by 128 bits of hashes and found by partial aggregation, and count as linked with each other. A cell with more than BLOCK
    classes is split and its visitors are dealt to each part; links are counted where they are met and each block gives a spanning
    forest, so no list of all pairs is ever made. The driver gets the bounded sample and counts. Extra columns are not read, whatever
    their names.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "vectors")
    clean = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + F.lit(0.0))
    ok = F.col("label").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0), F.lit(False))
    src = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), clean.alias("v")).withColumn("h1", F.when(ok, F.xxhash64("label", "v")))
    src = src.withColumn("h2", F.when(F.col("h1").isNotNull(), F.xxhash64(F.lit(1), "v", "label")))
    classes = src.where("h1 is not null").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("w"), F.any_value("label").alias("label"), F.any_value("v").alias("v"))
    classes = scratch.save(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    dim = classes.agg(F.max(F.size("v"))).first()[0] or 0
    hottest = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    sample = [r.v for r in classes.select("v", "h1").orderBy("h1").limit(SAMPLE).select("v").toLocalIterator()] if dim else []
    index = fit(unit(sample, dim), hottest, cosine, recall) if sample else MultiIndex(dim, np.zeros((1, 0)), np.zeros((1, 0)), 1)
    shared = spark.sparkContext.broadcast(index)
    n_visits = min(index.visits, len(index.left) * len(index.right))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = shared.value.cells(unit(batch.column(1).to_pylist(), dim))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, cells.size + 1, cells.shape[1], dtype="int32")), pa.array(cells.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["cid", "visits"])

    visits = scratch.save(classes.select("cid", "v").mapInArrow(place, "cid long, visits array<long>"), "visits")
    placed = classes.join(visits, "cid").select("cid", "w", F.struct("label", F.size("v").alias("d")).alias("l"), F.col("visits")[0].alias("cell"), "visits", "v")
    parts = placed.groupBy("l", "cell").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("l", "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    some = lambda df: df.join(parts, ["l", "cell"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    held = some(placed).select(F.xxhash64("l", "cell", F.pmod(F.xxhash64("cid"), "parts").cast("int")).alias("gkey"), F.lit(0).alias("probe"), "cid", "w", "cell", "visits", "v")
    asks = some(placed.select("cid", "w", "l", F.col("cell").alias("own"), "v", F.explode("visits").alias("cell")))
    asks = asks.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asks = asks.select(F.xxhash64("l", "cell", "part").alias("gkey"), F.lit(1).alias("probe"), "cid", "w", F.col("own").alias("cell"), F.lit(None).cast("array<long>").alias("visits"), "v")
    met = held.unionByName(asks).repartition("gkey").sortWithinPartitions("gkey", "probe")
    found = scratch.save(met.mapInArrow(lambda it: _compare(it, dim, cosine, n_visits), "cid long, links long, other long"), "found")

    counts = found.where("other is null").groupBy("cid").agg(F.sum("links").alias("links"))
    linked = components(spark, found.where("other is not null").select(F.col("cid").alias("a"), F.col("other").alias("b")), scratch)
    own = classes.select("h1", "h2", "cid", "id", "w").join(counts, "cid", "left").join(linked.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = own.groupBy("component").agg(F.min("id").alias("component_id"))
    named = own.join(least, "component").select("h1", "h2", "component_id", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = src.select("id", "h1", "h2").join(named, ["h1", "h2"], "left").select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
near AS (SELECT a.rid AS x, b.rid AS y FROM ok a JOIN ok b ON a.label = b.label AND a.rid <> b.rid AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT rid AS r, rid AS t FROM v UNION SELECT r, y FROM reach JOIN near ON t = x),
c AS (SELECT r AS rid, min(vec_id) AS component_id FROM reach JOIN (SELECT rid AS t, vec_id FROM v) USING (t) GROUP BY r)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c USING (rid) LEFT JOIN (SELECT x AS rid, count(*) AS n_links FROM near GROUP BY x) USING (rid)
"""
