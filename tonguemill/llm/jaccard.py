"""Exact n-gram Jaccard join by universe partitioning.

A document is the set of its distinct 5-word shingles. Two sets of similarity 0.8 or more differ in at most D shingles, D following
from their sizes. For a band of sizes the universe of shingles is hashed into m segments; the part of a set in a segment is indexed
under its hash and, in q of the segments, also under the hashes of its one-deletion neighbours. Each segment that is met whole, and
each of the q that is met but for one shingle, uses up less than its share of D, so by the pigeonhole principle two linked sets share
more than V - D - 1 keys, V = m + q. Costs decide twice: m and q are those of least estimated cost for the band, and of its keys each
set probes only the cheapest, leaving out as many of the shortest and most frequent as the principle allows. Candidates are verified
on the sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonguemill.llm.common import Scratch, components, mix, row_key, spread, table, utf8, word_hashes

SHINGLE, PERCENT = 5, 80
#: Growth of the size bands, what a key of one shingle or none costs beside that of any key (such keys are met by chance), and the share
#: of the least cost within which fewer and longer segments are taken instead. README has the keys and candidates measured by band.
BAND, WEAK, NEAR = 2.0, 1.0, 0.05
#: Partitions of the universe, one after the other, that a set tries which has too few parts with a shingle in those before.
LEVELS = 8
#: Rounds in which sets meet those nearest to them in other components; what these leave apart is compared in full.
ROUNDS, PROBES, BLOCK = 3, 4, 1024
#: Bits of a set's parity sketch: two sets' sketches differ in no more bits than the sets differ in shingles. And the 64-bit words of
#: the shorter sketch that its parts give when laid over each other, for which the same holds.
SKETCH, FOLDED = 4096, 8
#: Rows of a key beyond which it is dealt over several tasks, and the share of sets (one in so many) and the number of keys or shingles
#: from which such keys are told before they are met. What is told decides only where rows go, never which pairs are compared.
#: SALTS is the least number of tasks that it is dealt over.
WIDE, SAMPLED, TOLD, SALTS = 2048, 64, 20_000, 64
#: Texts that are hashed at once, and pairs that a task remembers so as not to give them again.
ROWS, GIVEN = 500, 500_000
_U = np.uint64


def shingle_lists(texts: list[str | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets): for each text the sorted distinct 64-bit hashes of its runs of `size` words; of a shorter text the whole
    sequence as one; none without words."""
    h, n = word_hashes([t.lower() for t in utf8(texts)])
    first = np.cumsum(n) - n
    s, short = h.copy(), np.zeros(len(texts), "uint64")
    for k in range(1, size):  # s holds runs of k words here
        short[n == k] = s[first[n == k]]
        s[: max(0, len(s) - k)] = s[: max(0, len(s) - k)] * _U(0x9E3779B97F4A7C15) + h[k:]
    runs = np.where(n < size, (n > 0).astype("int64"), n - size + 1)
    out = s[spread(first, runs)]
    at = np.cumsum(runs)
    whole = (n > 0) & (n < size)
    out[at[whole] - 1] = short[whole]
    out = mix(out + np.repeat(np.minimum(n, size).astype("uint64"), runs))
    for a, b in zip((at - runs).tolist(), at.tolist(), strict=True):
        out[a:b].sort()
    keep = np.append(True, out[1:] != out[:-1])[: len(out)]
    keep[(at - runs)[runs > 0]] = True
    kept = np.append(0, np.cumsum(keep))
    return out[keep], np.append(0, kept[at])


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    return shingle_lists([text], size)[0]


def set_ids(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set, of different functions; sets are taken as equal where both are."""
    n = np.diff(offsets).astype("uint64")
    sums = [np.diff(np.append(_U(0), np.cumsum(mix(values + _U(c))))[offsets]) for c in (0, 0xD1B54A32D192ED03)]
    return tuple(mix(x + n).view("int64") for x in sums)


def most_apart(smaller: int, percent: int = PERCENT) -> int:
    """Most shingles in which a set of this size differs from any linked set that is no smaller."""
    return smaller * (100 - percent) // percent


@lru_cache(maxsize=None)
def bands() -> tuple[int, ...]:
    """First sizes of the bands."""
    out = [1]
    while out[-1] < 1 << 30:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * BAND)))
    return tuple(out)


def spare(band: int, percent: int = PERCENT) -> int:
    """Keys that each set publishes beyond those needed, so that as many of its most frequent ones can be left out."""
    return 2 + most_apart(bands()[band + 1] - 1, percent) // 16


def _share(n: float, m: int, k: int) -> float:
    """Share of the m parts that hold k of n shingles."""
    if m == 1:
        return float(k == n)
    return math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - k * math.log(m) + (n - k) * math.log1p(-1 / m)) if n >= k else 0.0


@lru_cache(maxsize=None)
def allocation(band: int, percent: int = PERCENT) -> tuple[int, int]:
    """(m, q): segments, and how many of them have one-deletion neighbourhoods; (0, 0) where linked sets are equal.

    The least cost, in keys and weak keys that a set publishes, of those with enough parts that hold a shingle, as a rule; of costs that
    are NEAR the least, that of the longest segments, which fewest sets share by chance.
    """
    low, high = bands()[band], bands()[band + 1] - 1
    if not most_apart(high, percent):
        return 0, 0

    def units(n: int, m: int, q: int) -> float:
        none, one = _share(n, m, 0), _share(n, m, 1)
        return m * (1 - none) + q * (1 - none - one)

    def cost(m: int, q: int) -> float:
        total = 0.0
        for n in (low, (low + high) // 2, high):
            one, two = _share(n, m, 1), _share(n, m, 2)
            keys, weak = m * (1 - _share(n, m, 0)) + q * (n / m - one), m * one + 2 * q * two
            drop = max(0.0, units(n, m, q) - most_apart(n, percent) - 1 - spare(band, percent))
            total += keys - drop + WEAK * max(0.0, weak - drop)
        return total

    least, options = high / 4, []
    for tenths in (0, 2, 5, 10):
        for k in range(60):
            m = max(1, round(least * 1.07**k / (1 + tenths / 10)))
            q = m * tenths // 10
            if all(units(n, m, q) - 2 * math.sqrt(m * _share(n, m, 0)) >= most_apart(n, percent) + 1 for n in (low, high) if most_apart(n, percent)):
                options.append((cost(m, q), m, q))
    few = min(options)[0] * (1 + NEAR)
    return min((m, q) for c, m, q in options if c <= few)


@lru_cache(maxsize=1 << 17)
def schemes(n: int, percent: int = PERCENT) -> tuple[tuple[int, int], ...]:
    """(band, most that a set of n may differ by in it): its own, and those of smaller sets that it may be linked with; none where
    linked sets are equal."""
    edges = bands()
    own = int(np.searchsorted(edges, n, "right")) - 1
    out = [(own, most_apart(n, percent))]
    least, band = -(-n * percent // 100), own - 1
    while band >= 0 and edges[band + 1] - 1 >= least:
        high = edges[band + 1] - 1
        out.append((band, min(most_apart(high, percent), (high + n) * (100 - percent) // (100 + percent))))
        band -= 1
    return tuple(x for x in out if allocation(x[0], percent)[0])


def keys_of(values: np.ndarray, offsets: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, ...]:
    """(set, band, budget, key) of the keys that sets publish, by set. Any two linked sets share more keys of a band than the larger
    budget of both.

    A set of which m + q - lost keys remain (lost are those of parts without a shingle, and of neighbourhoods of a single one) shares
    more than c = m + q - lost - D - 1 with each linked set, so the c weakest need not be met. Keys beyond `spare` of these are left out
    here, those of the fewest shingles first, which both of a pair do in one order; the others are left out by their frequency.
    Where too many are lost (c < 0) all are published, and those of another partition of the universe too: of two linked sets one has
    enough in the first partition that either of them stops at, and there they meet. Sets that don't stop at any, about one in 10^10,
    publish keys of their empty parts; these, and only these, are odd.
    """
    told = [(i, band, apart, *allocation(band, percent)) for i, n in enumerate(np.diff(offsets).tolist()) if n for band, apart in schemes(n, percent)]
    which, band, apart, m, q = np.array(told, "int64").reshape(-1, 5).T
    room = np.array([spare(int(b), percent) for b in band], "int64")
    x = mix(values + _U(0x5851F42D4C957F2D))
    out = []
    for level in range(LEVELS):
        size = (offsets[1:] - offsets[:-1])[which]
        at, item = spread(offsets[:-1][which], size), np.repeat(np.arange(len(which)), size)
        place = mix(values + _U(level)) >> _U(20)
        part = (place[at] % m.astype("uint64")[item]).astype("int64") | item << 32
        order = np.argsort(part)
        part, at, item = part[order], at[order], item[order]
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)])
        held = np.diff(np.append(first, len(part)))
        own, seg = item[first], part[first] & 0xFFFFFFFF
        sums = np.add.reduceat(x[at], first) if len(first) else np.empty(0, "uint64")
        base = mix((band * LEVELS + level + 1).astype("uint64"))
        salt = lambda i, g: (g + 1).astype("uint64") * _U(0xD6E8FEB86659FD93) + base[i]
        full = lambda k: mix(k) & ~_U(1)
        near = seg < q[own]
        more = near & (held > 1)
        each = np.repeat(np.arange(len(first)), held)
        drop = more[each]
        to = each[drop]
        units = np.bincount(own, minlength=len(which)) + np.bincount(own[more], minlength=len(which))
        c = units - apart - 1
        keys = np.concatenate([full(sums ^ salt(own, seg)), full((sums[to] - x[at[drop]]) ^ salt(own[to], seg[to]))])
        of, content = np.concatenate([own, own[to]]), np.concatenate([held, held[to] - 1])
        rank = np.lexsort((keys, content, of))
        keys, of = keys[rank], of[rank]
        starts = np.cumsum(np.bincount(of, minlength=len(which)))
        nth = np.arange(len(of)) - np.append(0, starts)[of]
        stay = nth >= np.maximum(0, c - room)[of]
        out.append((which[of[stay]], band[of[stay]], np.clip(c, 0, room)[of[stay]], keys[stay]))
        failed = np.flatnonzero(c < 0)
        if not len(failed):
            break
        which, band, apart, m, q, room = (z[failed] for z in (which, band, apart, m, q, room))
        if level + 1 == LEVELS:
            for i, f in enumerate(failed):
                empty = np.setdiff1d(np.arange(m[i]), seg[own == f])
                ghost = mix((empty + 1).astype("uint64") * _U(0xD6E8FEB86659FD93) + base[f]) | _U(1)
                out.append((np.full(len(empty), which[i]), np.full(len(empty), band[i]), np.zeros(len(empty), "int64"), ghost))
    cols = [np.concatenate(z) for z in zip(*out, strict=True)]
    order = np.argsort(cols[0], kind="stable")
    return tuple(z[order] for z in cols)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype("int32")), pa.array(values))


def _sets(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(rid, text) to (rid, n, h1, h2, keys, metas): a meta holds a key's band, its budget there and the set's size."""
    for whole in batches:
        for a in range(0, whole.num_rows, ROWS):
            batch = whole.slice(a, ROWS)
            values, offsets = shingle_lists(batch.column(1).to_pylist())
            n = np.diff(offsets)
            of, band, budget, keys = keys_of(values, offsets, percent)
            metas = band << 55 | np.minimum(budget, (1 << 24) - 1) << 31 | n[of]
            counts = np.bincount(of, minlength=len(n))
            cols = [batch.column(0), *map(pa.array, (n, *set_ids(values, offsets))), _lists(keys.view("int64"), counts), _lists(metas, counts)]
            yield pa.RecordBatch.from_arrays(cols, names=["rid", "n", "h1", "h2", "keys", "metas"])


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set, h1, h2, text) to (set, shingles, parity sketch, folded sketch) of the texts that have the set's hashes."""
    for whole in batches:
        for a in range(0, whole.num_rows, ROWS):
            batch = whole.slice(a, ROWS)
            values, offsets = shingle_lists(batch.column(3).to_pylist())
            n, rows = np.diff(offsets), batch.num_rows
            h1, h2 = set_ids(values, offsets)
            right = pa.array((h1 == np.asarray(batch.column(1))) & (h2 == np.asarray(batch.column(2))))
            bits = np.repeat(np.arange(rows), n) * SKETCH + (mix(values) % _U(SKETCH)).astype("int64")
            sketches = np.packbits((np.bincount(bits, minlength=rows * SKETCH) & 1).astype("uint8").reshape(rows, SKETCH), axis=1)
            folded = np.bitwise_xor.reduce(sketches.view("int64").reshape(rows, -1, FOLDED), axis=1)
            cols = [batch.column(0), _lists(values.view("int64"), n), pa.array([x.tobytes() for x in sketches], pa.binary()), *[pa.array(folded[:, i].copy()) for i in range(FOLDED)]]
            yield pa.RecordBatch.from_arrays(cols, names=["set", "s", "sketch", *[f"f{i}" for i in range(FOLDED)]]).filter(right)


def _nearest(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, component, set, n, sketch) sorted by key: each with that of its block of the key that is nearest by sketch, among the
    other components and unless the sketches rule a link out. Blocks hold BLOCK rows at most."""

    def block(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        comp, ids, n = (np.array([r[i] for r in rows], "int64") for i in (1, 2, 3))
        sketch = np.frombuffer(b"".join(r[4] for r in rows), "uint64").reshape(len(rows), -1)
        out = np.full(len(rows), -1)
        for i in range(len(rows)):
            bits = np.bitwise_count(sketch ^ sketch[i]).sum(1, dtype="int64")
            ok = (comp != comp[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])) & (bits * (100 + percent) <= (n + n[i]) * (100 - percent))
            if ok.any():
                out[i] = np.where(ok, bits, SKETCH + 1).argmin()
        has = out >= 0
        return ids[has], ids[out[has]]

    def give(done: list[tuple]) -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.empty(0, "int64"),) * 2
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    held: list[tuple] = []
    for batch in batches:
        done = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (row[0] != held[0][0] or len(held) == BLOCK):
                if len(held) > 1:
                    done.append(block(held))
                held = []
            held.append(row)
        yield give(done)
    if len(held) > 1:
        yield give([block(held)])


def _cross(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, component, set, n, folded sketch) sorted by key and component to pairs of sets of different components, of which
    neither the sizes nor the sketches rule a link out.

    Each row meets those of its key that stand after its component, so a component's own pairs are never made.
    """
    given: set[tuple[int, int]] = set()

    def pairs(key: np.ndarray, comp: np.ndarray, ids: np.ndarray, n: np.ndarray, *sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
        words = np.stack(sketch, axis=1)
        ends = np.append(np.flatnonzero(np.diff(key)) + 1, len(key))
        end = np.repeat(ends, np.diff(ends, prepend=0))
        blocks = np.append(np.flatnonzero((np.diff(key) != 0) | (np.diff(comp) != 0)) + 1, len(key))
        j = np.repeat(blocks, np.diff(blocks, prepend=0))
        i = np.flatnonzero(j < end)
        j = j[i]
        while len(i):
            ok = (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & (ids[i] != ids[j])
            a, b = i[ok], j[ok]
            apart = np.bitwise_count(words[a] ^ words[b]).sum(1, dtype="int64")
            ok = apart * (100 + percent) <= (n[a] + n[b]) * (100 - percent)
            if ok.any():
                x, y = ids[a[ok]], ids[b[ok]]
                own = [p for p in set(zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist(), strict=True)) if p not in given]
                if len(given) > GIVEN:
                    given.clear()
                given.update(own)
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in own], pa.int64()), pa.array([p[1] for p in own], pa.int64())], names=["a", "b"])
            j = j + 1
            i, j = i[j < end[i]], j[j < end[i]]

    held: list[np.ndarray] = []
    for batch in batches:
        if batch.num_rows:
            rows = np.concatenate([*held, np.stack([np.asarray(c) for c in batch.columns])], axis=1)
            cut = int(np.searchsorted(rows[0], rows[0][-1], "left"))
            if cut:
                yield from pairs(*rows[:, :cut])
            held = [rows[:, cut:]]
    if held:
        yield from pairs(*held[0])


def _cells(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (cell, right, component, set, n, folded sketch) sorted by cell to the pairs that _cross gives, of those on its left with those
    on its right. A cell has two blocks of about WIDE rows."""

    def pairs(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        left, right = (rows[2:, rows[1] == k] for k in (0, 1))
        comp, ids, n, words = right[0], right[1], right[2], np.ascontiguousarray(right[3:].T)
        a, b, held = [], [], 0
        for i in range(left.shape[1]):
            at = np.flatnonzero((comp != left[0, i]) & (100 * np.minimum(n, left[2, i]) >= percent * np.maximum(n, left[2, i])))
            apart = np.bitwise_count(words[at] ^ left[3:, i]).sum(1, dtype="int64")
            at = at[apart * (100 + percent) <= (n[at] + left[2, i]) * (100 - percent)]
            if len(at):
                a.append(np.maximum(ids[at], left[1, i]))
                b.append(np.minimum(ids[at], left[1, i]))
                held += len(at)
            if held > 20_000 or (held and i + 1 == left.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], names=["a", "b"])
                a, b, held = [], [], 0

    held: list[np.ndarray] = []
    for batch in batches:
        rows = np.stack([np.asarray(c) for c in batch.columns])
        for part in np.split(rows, np.flatnonzero(np.diff(rows[0])) + 1, axis=1) if batch.num_rows else []:
            if held and held[0][0, 0] != part[0, 0]:
                yield from pairs(np.concatenate(held, axis=1))
                held = []
            held.append(part)
    if held:
        yield from pairs(np.concatenate(held, axis=1))


def prefix(s: np.ndarray, percent: int, hot: np.ndarray) -> np.ndarray:
    """The first shingles of a set in an order of all shingles that has the hot ones last: two linked sets share one of these."""
    order = np.lexsort((s, np.isin(s, hot)))
    return s[order[: len(s) - -(-len(s) * percent // 100) + 1]]


def _prefixes(batches: Iterator[pa.RecordBatch], percent: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(set, component, shingles) to (key, component, set, n)."""
    for whole in batches:
        for a in range(0, whole.num_rows, 500):
            ids, comp, sets = (c.to_pylist() for c in whole.slice(a, 500).columns)
            got = [prefix(np.array(s, "int64"), percent, hot) for s in sets]
            counts = [len(k) for k in got]
            cols = [np.concatenate(got), *[np.repeat(np.array(c, "int64"), counts) for c in (comp, ids, [len(s) for s in sets])]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "component", "set", "n"])


def _spanning(rows: DataFrame) -> DataFrame:
    """The rows of keys that several components have; counted in parts, then joined, so no task holds all of a key."""
    ends = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    return rows.join(ends, "key", "left_semi")


def _dealt(rows: DataFrame, main: DataFrame) -> DataFrame:
    """Rows of wide keys to (cell, right, component, set, n, ...). main (key, lead, n_lead, total) names each key's largest component.

    The others' rows meet all, the largest component's meet only theirs. Both are dealt in blocks, and a cell is a pair of blocks.
    """
    blocks = lambda n: F.ceil(n / F.lit(WIDE)).cast("int")
    rows = rows.join(main, "key").withColumn("other", F.col("component") != F.col("lead")).withColumn("nr", blocks(F.col("total") - F.col("n_lead"))).withColumn("nm", blocks(F.col("n_lead")))
    dealt = lambda n: F.pmod(F.xxhash64("set"), n).cast("int")
    rows = rows.withColumn("block", F.when(F.col("other"), dealt(F.col("nr"))).otherwise(F.col("nr") + dealt(F.col("nm"))))
    to = F.transform(F.sequence(F.when(F.col("other"), F.col("block")).otherwise(F.lit(0)), F.col("nr") - 1), lambda j: F.struct(F.col("block").alias("i"), j.alias("j"), F.lit(0).cast("long").alias("right")))
    over = F.concat(F.sequence(F.lit(0), F.col("block")), F.sequence(F.col("nr"), F.col("nr") + F.col("nm") - 1))
    back = F.transform(over, lambda i: F.struct(i.alias("i"), F.col("block").alias("j"), F.lit(1).cast("long").alias("right")))
    rows = rows.withColumn("at", F.explode(F.when(F.col("other"), F.concat(to, back)).otherwise(to)))
    return rows.select(F.xxhash64("key", "at.i", "at.j").alias("cell"), "at.right", "component", "set", "n")


def _told(counts: DataFrame, name: str, least: int) -> dict[int, int]:
    """The most frequent values of a sample, at most TOLD, and how often each stands there; the driver gets no more."""
    return {r[0]: r[1] for r in counts.groupBy(name).agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n")).limit(TOLD).collect()}


def _across(apart: DataFrame, arrays: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Pairs (a, b) of sets of different components that share a key of apart, unless the sizes or sketches rule a link out.

    Where a wide key has more pairs than a cell, its sets meet by the prefixes of their shingles instead, rare ones first, which linked
    sets share too. Keys that are wide after that are dealt over cells.
    """

    def widths(rows: DataFrame) -> DataFrame:
        per = rows.groupBy("key", "component").agg(F.count("*").alias("c"))
        per = per.groupBy("key").agg(F.sum("c").alias("total"), F.max(F.struct("c", "component")).alias("most"), F.sum(F.col("c") * F.col("c")).alias("own"))
        wide = per.where(F.col("total") > WIDE)
        return wide.select("key", F.col("most.component").alias("lead"), F.col("most.c").alias("n_lead"), "total", ((F.col("total") * F.col("total") - F.col("own")) / 2 > WIDE * WIDE).alias("many"))

    apart = scratch.save(_spanning(apart.select("key", "component", "set", "n")), "across")
    main = scratch.save(widths(apart), "widths")
    many = main.where("many").select("key")
    if not many.isEmpty():
        heavy = apart.join(many, "key", "left_semi").select("set", "component").distinct()
        heavy = scratch.save(heavy.join(arrays.select("set", "s"), "set").select("set", "component", "s"), "heavy")
        hot = _told(heavy.where(F.pmod(F.xxhash64("set"), F.lit(16)) == 0).select(F.explode("s").alias("shingle")), "shingle", WIDE // 64)
        hot = np.array(sorted(hot), "int64")
        rows = scratch.save(heavy.mapInArrow(lambda it: _prefixes(it, percent, hot), "key long, component long, set long, n long"), "prefixes")
        apart = scratch.save(apart.join(many, "key", "left_anti").union(_spanning(rows).select("key", "component", "set", "n")), "across_rare")
        main = scratch.save(widths(apart), "widths_rare")
    short = [f"f{i}" for i in range(FOLDED)]
    names = ["component", "set", "n", *short]
    sketches = arrays.select("set", *short)
    narrow = apart if main.isEmpty() else apart.join(main, "key", "left_anti")
    out = narrow.join(sketches, "set").select("key", *names).repartition("key").sortWithinPartitions("key", "component").mapInArrow(lambda it: _cross(it, percent), "a long, b long")
    if not main.isEmpty():
        cells = _dealt(apart.join(main, "key", "left_semi"), main).join(sketches, "set").select("cell", "right", *names)
        out = out.union(cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(lambda it: _cells(it, percent), "a long, b long"))
    return out.distinct()


def _verified(pairs: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    left, right = arrays.select(F.col("set").alias("a"), F.col("s").alias("sa")), arrays.select(F.col("set").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, row_col: str | None = None) -> DataFrame:
    """(id, n_shingles, component_id) for each row of docs; with row_col, a long that tells rows apart, also that and `component`.

    `component` is the same for rows of one component only, and null for rows without words; ids may repeat or be null.

    Null texts and texts without words have an empty set and are alone in their component; an empty table gives none. Equal sets are
    one node from the start and publish their keys once, however many copies there are. Near copies are joined in rounds: each set meets
    one set of another component, that which most of its keys name. Pairs inside a component are never made, and all others that share
    a key are verified in the end, so no link between components is missed. A null id is no candidate for the smallest. Texts are read
    whole; a task hashes ROWS of them at once. Extra columns are not read, whatever their names.

    Shingles are told apart by 64-bit hashes, which matters within a pair only, and equal sets by 128 bits.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([F.col(row_col).alias("rid")] if row_col else []))
    src = src if row_col else src.withColumn("rid", row_key("id", "text"))
    told = src.select(F.struct("id", "rid").alias("rid"), "text").mapInArrow(
        lambda it: _sets(it, percent), f"rid struct<id:{docs.schema[id_col].dataType.simpleString()},rid:long>, n long, h1 long, h2 long, keys array<long>, metas array<long>"
    )
    # a row's number holds for the table that is written here; a set is named by the least number of its rows
    members = scratch.save(told.select("rid.id", "rid.rid", "n", "h1", "h2", "keys", "metas", F.monotonically_increasing_id().alias("nid")), "members")
    nodes = scratch.save(members.where("n > 0").groupBy("h1", "h2").agg(F.min("nid").alias("set"), F.min("id").alias("least")), "nodes")

    firsts = members.where(F.size("keys") > 0).select(F.col("nid").alias("set"), "keys", "metas").join(nodes.select("set"), "set", "left_semi")
    keyed = firsts.select("set", F.explode(F.arrays_zip("keys", "metas")).alias("x")).select(F.col("x.keys").alias("key"), "set", F.col("x.metas").alias("meta"))
    some = members.where(F.pmod(F.xxhash64("h1", "h2"), F.lit(SAMPLED)) == 0).select("h1", "h2", F.explode("keys").alias("key")).distinct()
    hot = _told(some, "key", max(2, WIDE // SAMPLED))
    by_key = ["key"]
    if hot:  # at most TOLD keys; a hot key's rows are dealt by salt, at most about WIDE to each, and its parts are summed up after
        known = F.broadcast(spark.createDataFrame([(k, max(SALTS, math.ceil(n * SAMPLED / WIDE))) for k, n in hot.items()], "key long, salts long"))
        keyed = keyed.join(known, "key", "left").withColumn("salt", F.pmod(F.xxhash64("set"), F.col("salts"))).drop("salts")
        by_key.append("salt")
    parts = Window.partitionBy(*by_key)
    several = F.min("set").over(parts) != F.max("set").over(parts)
    shared = keyed.select("*", F.count("*").over(parts).alias("g"), several.alias("several")).where(F.col("several") | F.col("salt").isNotNull() if hot else F.col("several"))
    shared = scratch.save(shared.drop("several"), "shared")
    if hot:
        whole = shared.where("salt is not null").groupBy("key").agg(F.count("*").alias("all"), (F.min("set") != F.max("set")).alias("several"))
        shared = shared.join(whole, "key", "left").where("salt is null or several").withColumn("g", F.coalesce("all", "g"))
    # of each set's shared keys in a band as many of the most frequent as it has to spare need not be met: both keep the cheapest
    costly = Window.partitionBy("set", F.shiftright("meta", 55)).orderBy(F.desc("g"), F.desc("key"))
    budget = F.shiftright("meta", 31).bitwiseAND(F.lit((1 << 24) - 1))
    size = F.col("meta").bitwiseAND(F.lit((1 << 31) - 1))
    kept = shared.withColumn("r", F.row_number().over(costly)).where(F.col("r") > budget).select("key", "set", size.alias("n"))
    kept = scratch.save(kept, "kept")
    scratch.drop("shared")
    members = scratch.save(members.drop("keys", "metas"), "rows")
    scratch.drop("members")

    met = members.select(F.col("nid").alias("set"), "rid", "h1", "h2").join(kept.select("set").distinct(), "set", "left_semi")
    texts = src.select("rid", "text").join(met, "rid").select("set", "h1", "h2", "text")
    arrays = scratch.save(texts.mapInArrow(_arrays, "set long, s array<long>, sketch binary, " + ", ".join(f"f{i} long" for i in range(FOLDED))).dropDuplicates(["set"]), "arrays")

    apart, links, linked = kept.withColumn("component", F.col("set")), None, None
    near = 100 * F.least("n", "lead.n") >= percent * F.greatest("n", "lead.n")
    for k in range(ROUNDS):
        # keys that join several components; first each set meets the least of a key, then the nearest in a few of its keys
        if k == 0:
            led = apart.groupBy("key").agg(F.min(F.struct("component", "set", "n")).alias("lead"), F.max("component").alias("last")).where("lead.component < last").drop("last")
            apart = scratch.save(apart.join(led, "key"), f"apart{k}")
        else:
            apart = scratch.save(_spanning(apart), f"apart{k}")
        if k == 0:
            votes = apart.where((F.col("component") != F.col("lead.component")) & near).groupBy("set", F.col("lead.set").alias("other")).agg(F.count("*").alias("votes"))
            asked = votes.groupBy("set").agg(F.max_by("other", F.struct("votes", "other")).alias("other")).select(F.greatest("set", "other").alias("a"), F.least("set", "other").alias("b")).distinct()
        else:
            turn = F.row_number().over(Window.partitionBy("set").orderBy(F.xxhash64("key", F.lit(k)), "key"))
            few = scratch.save(apart.withColumn("turn", turn).where(F.col("turn") <= PROBES).select("key", "component", "set", "n"), f"few{k}")
            wide = few.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > BLOCK)
            block = F.pmod(F.xxhash64("set", F.lit(k)), F.ceil(F.col("rows") / BLOCK))
            few = few.join(wide, "key", "left").withColumn("key", F.when(F.col("rows").isNotNull(), F.xxhash64("key", block)).otherwise(F.col("key")))
            few = few.join(arrays.select("set", "sketch"), "set").select("key", "component", "set", "n", "sketch").repartition("key").sortWithinPartitions("key", F.xxhash64("set", F.lit(k)))
            asked = few.mapInArrow(lambda it: _nearest(it, percent), "a long, b long").distinct()
        more = scratch.save(_verified(asked, arrays, percent), f"links{k}")
        if more.isEmpty():
            break
        links = more if links is None else links.union(more)
        linked = components(spark, links, scratch, f"round{k}_")
        scratch.drop(f"few{k}")
        apart = apart.select("key", "set", "n").join(linked.withColumnRenamed("node", "set"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    across = _across(apart, arrays, scratch, percent)
    rest = scratch.save(_verified(across, arrays, percent), "rest")
    if linked is None or not rest.isEmpty():
        linked = components(spark, rest if links is None else links.union(rest), scratch, "all")

    named = nodes.join(linked.withColumnRenamed("node", "set"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("h1", "h2", "component", "component_id")
    rows = members.select("id", "rid", "n", "h1", "h2")
    out = rows.where("n > 0").join(named, ["h1", "h2"], "left").unionByName(rows.where("n = 0"), allowMissingColumns=True)  # equal hashes of no words meet nothing
    row = [F.col("rid").alias(row_col), "component"] if row_col else []
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), *row)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS p, len(ws) AS n FROM d),
g AS (SELECT rid, p, n, string_agg(word, ' ') OVER (PARTITION BY rid ORDER BY p ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS s FROM w),
sh AS (SELECT DISTINCT rid, s FROM g WHERE p <= n - 4 OR p = 1),
n AS (SELECT rid, count(*) AS n FROM sh GROUP BY rid),
met AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.rid < b.rid GROUP BY ALL),
links AS (SELECT x, y FROM met JOIN n a ON a.rid = x JOIN n b ON b.rid = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
near AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT rid AS r, rid AS t FROM d UNION SELECT r, y FROM reach JOIN near ON t = x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (rid) JOIN (SELECT r AS rid, min(doc_id) AS component_id FROM reach JOIN (SELECT rid AS t, doc_id FROM d) USING (t) GROUP BY r) USING (rid)
"""
