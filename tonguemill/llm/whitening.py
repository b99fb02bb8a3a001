"""Embedding whitening from an exact characteristic polynomial.

Vectors become integers, so their scatter is an integer matrix. Its characteristic polynomial is computed modulo many primes, by
Hessenberg reduction, one row of a Spark job for each prime, and put together by Chinese remaindering. A symmetric matrix has real roots
only, so Descartes' rule counts the roots above a point exactly, multiple ones too; bisection isolates each to hundreds of bits.
Inverse iteration in fixed-point numbers of that precision gives the null space that belongs to a root.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from math import comb, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonguemill.llm.common import Scratch, table

#: Components that rows are projected on, and bits of precision of eigenvalues and of inverse iteration, relative to the trace.
COMPONENTS, BITS = 16, 256
#: Entries are multiples of 1 / GRID; moved by OFFSET they are positive for common embeddings. Entries of LARGEST or more in size aren't numbers here.
GRID, OFFSET, LARGEST = 64, 1_000_000, 2.0**34


def integers(column: str, entries: str = "double"):
    """floor(64 c) of each entry c, or null for a vector that is null, empty or holds null, non-finite or too large entries."""
    v = F.col(column).cast(f"array<{entries}>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(LARGEST)))
    return F.when(F.coalesce(fine, F.lit(False)) & (F.size(v) > 0), F.transform(v, lambda c: F.floor(c * GRID)))


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _products(x: np.ndarray) -> np.ndarray:
    """The sums of products of columns, exact: in floats, in long integers, or in Python's where those could overflow."""
    most = float(np.abs(x).max(initial=0)) ** 2 * len(x)
    kind = "float64" if most < 2**53 else "int64" if most < 2**62 else object
    x = x.astype(kind)
    return x.T @ x


def _scatter(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """(i, j, total) for i <= j: sums of the products of entries over a task's vectors; entry `dim` is 1, so its sums are those of entries."""
    sums = np.zeros((dim + 1, dim + 1), object)
    for batch in batches:
        x = _rows(batch.column(0), dim)
        for a in range(0, len(x), 4096):
            part = np.concatenate([x[a : a + 4096], np.ones((len(x[a : a + 4096]), 1), "int64")], 1)
            sums += np.array([[int(v) for v in row] for row in _products(part)], object)
    i, j = np.triu_indices(dim + 1)
    yield pa.RecordBatch.from_arrays([pa.array(i.astype("int32")), pa.array(j.astype("int32")), pa.array([Decimal(int(v)) for v in sums[i, j]], pa.decimal128(38, 0))], names=["i", "j", "total"])


def primes(product: int) -> list[int]:
    """Primes below 2**31, the largest first, whose product exceeds the one given."""

    def is_prime(n: int) -> bool:
        odd, twos = n - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        for base in (2, 3, 5, 7):  # enough below 3 * 10**9
            x = pow(base, odd, n)
            if x in (1, n - 1):
                continue
            for _ in range(twos - 1):
                x = x * x % n
                if x == n - 1:
                    break
            else:
                return False
        return True

    out, n, got = [], 2**31 - 1, 1
    while got <= product:
        if is_prime(n):
            out.append(n)
            got *= n
        n -= 2
    return out


def polynomial_modulo(c: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x - c) modulo a prime below 2**31, lowest power first, by reduction to Hessenberg form."""
    h = (c % p).astype("int64")
    d = len(h)
    for m in range(1, d - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        at = m + int(below[0])
        if at != m:
            h[[at, m]] = h[[m, at]]
            h[:, [at, m]] = h[:, [m, at]]
        u = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - u[:, None] * h[m]) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * u % p).sum(1)) % p
    polys = [np.ones(1, "int64")]
    for m in range(d):
        new = np.zeros(m + 2, "int64")
        new[1:] = polys[m]
        new[:-1] = (new[:-1] - h[m, m] * polys[m]) % p
        path = 1
        for i in range(m - 1, -1, -1):
            path = path * int(h[i + 1, i]) % p
            if not path:
                break
            new[: i + 1] = (new[: i + 1] - polys[i] * (path * int(h[i, m]) % p)) % p
        polys.append(new)
    return polys[d] % p


def combined(residues: dict[int, np.ndarray]) -> list[int]:
    """The integers, positive or negative, that have these residues modulo each prime."""
    product = 1
    for p in residues:
        product *= p
    out = [0] * len(next(iter(residues.values())))
    for p, r in residues.items():
        rest = product // p
        unit = rest * pow(rest, -1, p)
        out = [(a + int(b) * unit) % product for a, b in zip(out, r, strict=True)]
    return [a - product if 2 * a > product else a for a in out]


def roots_above(poly: list[int], at: int) -> int:
    """How many roots of a polynomial with real roots only, lowest power first, are greater: the sign changes of poly(x + at)."""
    c = list(poly)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += at * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def isolated(poly: list[int], k: int, bits: int) -> tuple[int, int, int]:
    """(low, above, here): the k-th largest root is in (low, low + 1] / 2**bits, with `above` roots beyond and `here` in it.

    Bisection counts roots; where an interval of integers holds one root alone, the polynomial's sign tells on which side it is.
    """
    lo, hi = 0, 1
    while roots_above(poly, hi) >= k:
        lo, hi = hi, 2 * hi
    lo -= lo == 0  # a root may be 0
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if roots_above(poly, mid) >= k else (lo, mid)
    beyond = roots_above(poly, hi)
    alone = roots_above(poly, lo) - beyond == 1
    fine = [c << bits * (len(poly) - 1 - i) for i, c in enumerate(poly)]
    lo, hi = lo << bits, hi << bits
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if alone:
            value = 0
            for c in reversed(fine):
                value = value * mid + c
            # the sign is that of (-1) ** (roots above)
            up = value != 0 and (value < 0) == ((beyond + 1) % 2 == 1)
        else:
            up = roots_above(fine, mid) >= k
        lo, hi = (mid, hi) if up else (lo, mid)
    if alone:
        return lo, beyond, 1
    beyond = roots_above(fine, hi)
    return lo, beyond, roots_above(fine, lo) - beyond


def null_space(c: np.ndarray, low: int, bits: int, many: int) -> list[np.ndarray]:
    """`many` orthogonal unit vectors, as integers over 2**bits, for the eigenvalue low / 2**bits of an integer matrix, by inverse iteration."""
    d, one = len(c), 1 << bits
    u = c * one
    u[np.diag_indices(d)] -= low
    order, factors = np.arange(d), np.zeros((d, d), object)
    for m in range(d):
        at = m + max(range(d - m), key=lambda i: abs(u[m + i, m]))
        for x in (u, factors):
            x[[m, at]] = x[[at, m]]
        order[[m, at]] = order[[at, m]]
        u[m, m] = u[m, m] or 1
        if m + 1 < d:
            factors[m + 1 :, m] = (u[m + 1 :, m] * one) // u[m, m]
            u[m + 1 :, m:] -= (factors[m + 1 :, m][:, None] * u[m, m:]) // one

    def unit(x: np.ndarray) -> np.ndarray:
        return x * one // (isqrt(int((x * x).sum())) or 1)

    def solved(b: np.ndarray) -> np.ndarray:
        y = b[order].copy()
        for m in range(d - 1):
            y[m + 1 :] -= factors[m + 1 :, m] * y[m] // one
        for m in range(d - 1, -1, -1):
            y[m] = y[m] * one // u[m, m]
            y[:m] -= u[:m, m] * y[m] // one
        return y

    rng, out = np.random.default_rng(3), []
    for _ in range(many):
        x = np.array([int(v) for v in rng.integers(1, 1000, d)], object) * one // 1000
        for _ in range(2):
            x = unit(solved(x))
            for _ in range(2):
                for known in out:
                    x = x - (x * known).sum() // one * known // one
                x = unit(x)
        out.append(x)
    return out


@dataclass(frozen=True)
class Whitening:
    """What rows are whitened by: n distinct vectors with sums of entries, components in rows, their eigenvalues and the trace, both of
    the scatter n * sum(x x') - S S', which is n**2 times the covariance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n x - S exactly, whitened rows)."""
        small = float(np.abs(x).max(initial=0)) * self.n + max((abs(s) for s in self.sums), default=0) < 2**62
        centred = x * self.n - self.sums.astype("int64") if small else x.astype(object) * self.n - self.sums
        return centred, centred.astype("float64") @ self.components.T / np.sqrt(self.values)


def _deviations(centred: np.ndarray) -> list[int | None]:
    """Sums of squares, exact; null where a long can't hold one."""
    about = (centred.astype("float64") ** 2).sum(1)
    if centred.dtype != object and (about < 2**62).all():
        return (centred * centred).sum(1).tolist()
    return [s if (s := sum(int(c) ** 2 for c in row)) < 2**63 else None for row in centred]


def fit(spark: SparkSession, distinct: DataFrame, dim: int, components: int = COMPONENTS, bits: int = BITS) -> Whitening:
    """Fits on distinct (x: `dim` integers). The driver gets dim**2 / 2 sums, dim coefficients for each prime, and the components."""
    parts = distinct.select("x").mapInArrow(lambda it: _scatter(it, dim), "i int, j int, total decimal(38,0)")
    g = np.zeros((dim + 1, dim + 1), object)
    for r in parts.groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
        g[r.i, r.j] = g[r.j, r.i] = int(r.total)
    n, sums = g[dim, dim], g[:dim, dim]
    none = Whitening(n, sums, np.zeros((0, dim)), np.zeros(0), np.zeros(0))
    c = g[:dim, :dim] * n - np.outer(sums, sums)
    trace = int(np.trace(c))
    if not trace:
        return none
    # all eigenvalues are at least 0, so the k-th coefficient is at most comb(dim, k) * (trace / dim) ** k
    bound = max(comb(dim, k) * (-(-(trace**k) // dim**k)) for k in range(dim + 1))
    shared = spark.sparkContext.broadcast(c)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([polynomial_modulo(shared.value, p).tolist() for p in own], pa.list_(pa.int64()))], names=["p", "coefficients"])

    moduli = primes(2 * bound)
    dealt = spark.createDataFrame([(p,) for p in moduli], "p long").repartition(min(len(moduli), 64))
    poly = combined({r.p: np.array(r.coefficients) for r in dealt.mapInArrow(reduce, "p long, coefficients array<long>").collect()})
    zeros = next(i for i, a in enumerate(poly) if a)  # a root of 0 has no direction to scale
    many = min(components, dim - zeros)
    scale = max(64, bits - trace.bit_length())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                low, above, here = isolated(poly, k, scale)
                x = null_space(shared.value, low, scale, here)[k - above - 1]
                x = x * (1 if max(x, key=abs) > 0 else -1)
                own = np.array([int(a) / (1 << scale) for a in x])
                value = (2 * low + 1) / (2 << scale)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([(own / np.linalg.norm(own)).tolist()], pa.list_(pa.float64())), pa.array([value]), pa.array([(2 * low + 1) / (trace << scale + 1)])], names=["k", "component", "value", "explained"])

    ks = spark.range(1, many + 1, numPartitions=many)
    found = sorted(ks.mapInArrow(find, "k long, component array<double>, value double, explained double").collect())
    return Whitening(n, sums, np.array([r.component for r in found]), np.array([r.value for r in found]), np.array([r.explained for r in found]))


def identity_error(spark: SparkSession, distinct: DataFrame, dim: int, model: Whitening) -> float:
    """The largest absolute entry of the whitened distinct vectors' covariance minus the identity."""
    shared, m = spark.sparkContext.broadcast(model), len(model.components)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((m + 1, m + 1))
        for batch in batches:
            w = np.column_stack([shared.value.project(_rows(batch.column(0), dim))[1], np.ones(batch.num_rows)])
            total += w.T @ w
        i, j = (x.ravel() for x in np.indices(total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(i.astype("int32")), pa.array(j.astype("int32")), pa.array(total.ravel())], names=["i", "j", "total"])

    total = np.zeros((m + 1, m + 1))
    for r in distinct.select("x").mapInArrow(products, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
        total[r.i, r.j] = r.total
    mean = total[:m, m] / model.n  # of centred vectors, so next to nothing
    return float(np.abs(total[:m, :m] / model.n - np.outer(mean, mean) - np.eye(m)).max())


def whiten_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, bits: int = BITS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each row and component.

    Rows whose vector is null or empty, or holds null, non-finite or too large entries (2**34 or more) are left out, and so are those of
    another length than most distinct vectors have (the longer one where lengths tie): they lack entries. Components whose eigenvalue is 0
    are left out, as nothing varies along them; so one distinct vector alone, or an empty table, gives no rows. Equal eigenvalues have
    components that span their space, the same for all rows. Repeated rows are fitted on once and returned each; deviation is null
    where a long can't hold it. Only the two columns are read, whatever the names of others.

    Distinct vectors are found by an aggregation that is partial before its shuffle, so a vector that a third of the rows share is a row
    for each task. Sums are exact: of integers in each task, of decimals between tasks.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "whitening")
    src = rows.select(F.col(id_col).alias("id"), integers(vector_col).alias("x")).where("x is not null")
    distinct = scratch.save(src.select("x").distinct().withColumn("size", F.size("x")), "distinct")
    lengths = distinct.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    schema = f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    dim = lengths.size
    own = distinct.where(F.col("size") == dim)
    model = fit(spark, own, dim, components, bits)
    if not len(model.components):
        return spark.createDataFrame([], schema)
    shared, error, m = spark.sparkContext.broadcast(model), identity_error(spark, own, dim, model), len(model.components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                k = part.num_rows
                centred, white = shared.value.project(_rows(part.column(1), dim))
                deviation = pa.array(_deviations(centred), pa.int64())
                at = pa.array(np.repeat(np.arange(k), m))
                constant = lambda v, kind: pa.array(np.full(k * m, v), kind)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), pa.array(np.tile(np.arange(1, m + 1, dtype="int32"), k)), constant(shared.value.n, pa.int64()), deviation.take(at), pa.array(white.ravel()), pa.array(np.tile(shared.value.explained, k)), constant(error, pa.float64())],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return src.where(F.size("x") == dim).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten_vectors(table(spark, sf_dir, "embeddings"))
