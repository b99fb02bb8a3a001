"""Substring dedup: suffix automata of reference shards, and documents streamed through them for matching statistics.

A corpus is its own reference, so each shard holds only what can match: every window of LENGTH words has a minimizer, the least hash
of its short word runs, and equal windows have equal minimizers. Contexts (the words of a document's consecutive windows with one
minimizer) go to the shard of their minimizer; those that no other context shares it with can't repeat and go nowhere. A shard's
suffix automaton counts in how many contexts each of its substrings stands; contexts stream through it, and maximal spans of LENGTH
words or more that stand in two contexts are removed. Shards are sent where their documents' contexts are, not everything to
everyone: broadcasting all shards to all documents would be quadratic work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonguemill.llm.common import BLANKS, Scratch, mix, row_key, run_hashes, spread, table, utf8, word_hashes

#: Words of a window, and of the runs whose hashes select its minimizer.
LENGTH, RUN = 35, 6
#: Distinct contexts of a minimizer beyond which its windows are counted by Spark's aggregation, exactly, instead of in one automaton.
SHARD = 1000
#: Texts that are hashed at once, and what a task remembers so as not to give it again.
ROWS, GIVEN = 500, 500_000
WHOLE, PART, WHOLE_TOLD, PART_HOT, WHOLE_HOT = range(5)
_TO_BLANK = {c: " " for c in BLANKS}
_U = np.uint64


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours, by doubling."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def contexts(raw: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text, minimizer, hash of the words, first window, windows, times) of each stretch of a text's windows with one minimizer.

    Stretches in which a window stands twice are cut into single windows; of equal ones the first is given, with how often it stands.
    """
    h, n_words = word_hashes(raw)
    windows = np.maximum(n_words - length + 1, 0)
    if not windows.sum():
        return tuple(np.empty(0, "int64") for _ in range(6))
    at = spread(np.cumsum(n_words) - n_words, windows)
    text, nth = np.repeat(np.arange(len(raw)), windows), at - np.repeat(np.cumsum(n_words) - n_words, windows)
    least, win = _window_min(run_hashes(h, RUN), length - RUN + 1)[at], run_hashes(h, length)[at]
    begins = np.append(True, (least[1:] != least[:-1]) | (text[1:] != text[:-1]))
    stretch = np.cumsum(begins) - 1
    own = mix(win + mix(text.astype("uint64")))  # equal for equal windows of a text
    order = np.argsort(own)
    same = (own[order][1:] == own[order][:-1]) & (stretch[order][1:] == stretch[order][:-1])
    cut = np.zeros(stretch[-1] + 1, bool)
    cut[stretch[order][1:][same]] = True
    starts = np.flatnonzero(begins | cut[stretch])
    n = np.diff(np.append(starts, len(at)))
    # hash of the windows of a stretch tells its words
    place = (2 * (np.arange(len(win)) - np.repeat(starts, n)) + 1).astype("uint64")
    c = mix(np.add.reduceat(mix(win + _U(1)) * place, starts) + n.astype("uint64"))
    times = np.ones(len(starts), "int64")
    single = np.flatnonzero(cut[stretch[starts]])
    if len(single):
        _, first, count = np.unique(own[starts[single]], return_index=True, return_counts=True)
        times[single] = 0
        times[single[first]] = count
    stay = times > 0
    starts = starts[stay]
    return text[starts], least[starts].view("int64"), c[stay].view("int64"), nth[starts], n[stay], times[stay]


def _windows(raw: bytes, length: int) -> np.ndarray:
    return run_hashes(word_hashes([raw])[0], length)


def _own_repeats(raw: bytes, length: int) -> list[tuple[int, int]]:
    """Windows that stand twice in the text itself."""
    _, at, count = np.unique(_windows(raw, length), return_inverse=True, return_counts=True)
    return [(i, length) for i in np.flatnonzero(count[at] > 1).tolist()]


def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(r1, r2, text) to the contexts of the texts, with their minimizers."""
    for whole in batches:
        for a in range(0, whole.num_rows, ROWS):
            batch = whole.slice(a, ROWS)
            text, m, c, first, n, times = contexts(utf8(batch.column(2).to_pylist()), length)
            cols = [m, c, *[np.asarray(batch.column(k))[text] for k in (0, 1)], first.astype("int32"), n.astype("int32"), times]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["m", "c", "__r1", "__r2", "a", "n", "times"])


class SuffixAutomaton:
    """Of several word sequences; `seen` counts, up to 2, in how many of them (by weight) a state's substrings stand."""

    def __init__(self):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.len, self.seen, self.last_of = [-1], [0], [2], [-1]

    def add(self, words: list[str], number: int, weight: int) -> None:
        nxt, link, length = self.next, self.link, self.len
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None and length[q] == length[last] + 1:
                last = q
                continue
            if q is None:
                cur = self._state({}, length[last] + 1)
                p = last
                while p >= 0 and w not in nxt[p]:
                    nxt[p][w] = cur
                    p = link[p]
                if p < 0:
                    link[cur] = 0
                else:
                    q = nxt[p][w]
                    link[cur] = q if length[p] + 1 == length[q] else self._clone(p, q, w)
                last = cur
            else:
                last = self._clone(last, q, w)
        v = 0
        for w in words:
            v = u = nxt[v][w]
            while u > 0 and self.last_of[u] != number:
                self.last_of[u] = number
                self.seen[u] += weight
                u = link[u]

    def _state(self, out: dict[str, int], n: int) -> int:
        self.next.append(out)
        self.link.append(0)
        self.len.append(n)
        self.seen.append(0)
        self.last_of.append(-1)
        return len(self.len) - 1

    def _clone(self, p: int, q: int, w: str) -> int:
        c = self._state(self.next[q].copy(), self.len[p] + 1)
        self.link[c], self.seen[c], self.last_of[c] = self.link[q], self.seen[q], self.last_of[q]
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def spans(self, words: list[str], length: int) -> list[tuple[int, int]]:
        """Maximal (start, words) spans of `length` or more that stand in two of the sequences, from matching statistics."""
        out: list[tuple[int, int]] = []
        v = n = 0
        for i, w in enumerate(words):
            while v and w not in self.next[v]:
                v = self.link[v]
                n = self.len[v]
            if w in self.next[v]:
                v, n = self.next[v][w], n + 1
            while self.seen[v] < 2:
                v = self.link[v]
                n = self.len[v]
            if n >= length:
                a = i - n + 1
                if out and a == out[-1][0]:
                    out[-1] = (a, i + 1 - a)
                else:
                    out.append((a, i + 1 - a))
        return out


def _shards(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Contexts (m, r1, r2, a, kind, words) sorted by their first four to spans (r1, r2, a, n) of those that aren't known as repeated whole.

    A row that is repeated whole gives a context once in each task that has it; one of these is taken.
    """
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())

    def give(held: list[tuple]) -> pa.RecordBatch:
        automaton = SuffixAutomaton()
        own = [(*row, text.split(" ")) for *row, text in held]
        for k, (*_, kind, words) in enumerate(own):
            automaton.add(words, k, 2 if kind == WHOLE_TOLD else 1)
        rows = [(r1, r2, a + s, n) for r1, r2, a, kind, words in own if kind == PART for s, n in automaton.spans(words, length)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)], names=["__r1", "__r2", "a", "n"])

    held, key = [], None
    for batch in batches:
        for m, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if m != key:
                if len(held) > 1:
                    yield give(held)
                held, key = [], m
            if not held or tuple(row[:3]) != held[-1][:3]:
                held.append(tuple(row))
    if len(held) > 1:
        yield give(held)


def _cover(n: int, spans) -> np.ndarray:
    edge = np.zeros(n + 1, "int64")
    for a, k in spans:
        edge[a] += 1
        edge[a + k] -= 1
    return np.cumsum(edge)[:n] > 0


def cut_text(text: str, gone: np.ndarray) -> str:
    """The text without the words marked, each taken with the blanks before it; what stays keeps its own blanks."""
    if not gone.any():
        return text
    blanks, out, at, raw = BLANKS.decode(), [], 0, text.translate(_TO_BLANK)
    for w, g in zip([w for w in raw.split(" ") if w], gone.tolist(), strict=True):
        start = raw.index(w, at)
        if not g:
            out.append(text[at : start + len(w)] if out or not at else text[at : start + len(w)].lstrip(blanks))
        at = start + len(w)
    return "".join(out) + text[at:]


RESULT = ("n_words", "n_removed", "kept_sha256", "cleaned")
FIELDS = "n_words long, n_removed long, kept_sha256 string, cleaned string"
OPEN = "open string, spans array<struct<a:int,n:int>>, contexts array<struct<m:long,a:int,kind:int,words:string>>, windows array<struct<m:long,w:long,a:int,weight:int>>"


def _finish(text: str | None, words: list[bytes], spans, cleaned: bool) -> tuple:
    gone = _cover(len(words), spans) if spans else np.zeros(len(words), bool)
    stay = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if spans else words
    return len(words), len(words) - len(stay), hashlib.sha256(b" ".join(stay)).hexdigest(), (cut_text(text, gone) if text is not None else None) if cleaned else None


def _resolve(batches: Iterator[pa.RecordBatch], length: int, keep: list[str], cleaned: bool) -> Iterator[pa.RecordBatch]:
    """(keep..., r1, r2, text, notes) to finished rows, and open ones with what the shards need of them."""
    k = len(keep)
    met: dict[tuple[int, int], int] = {}  # windows of hot minimizers that this task has given, at most twice each
    sent: set[tuple[int, int, int]] = set()  # contexts known as repeated that this task has given for a row
    spans_of, context, window = pa.struct([("a", pa.int32()), ("n", pa.int32())]), pa.struct([("m", pa.int64()), ("a", pa.int32()), ("kind", pa.int32()), ("words", pa.string())]), pa.struct([("m", pa.int64()), ("w", pa.int64()), ("a", pa.int32()), ("weight", pa.int32())])
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(spans_of), pa.list_(context), pa.list_(window)]
    names = [*keep, "__r1", "__r2", *RESULT, "open", "spans", "contexts", "windows"]
    for whole in batches:
        for a0 in range(0, whole.num_rows, ROWS):
            batch = whole.slice(a0, ROWS)
            rows = []
            for r1, r2, text, notes in zip(*(batch.column(k + i).to_pylist() for i in range(4)), strict=True):
                raw = utf8([text])[0]
                words, notes = raw.split(), notes or []
                spans = [(x["a"], x["n"] + length - 1) for x in notes if x["kind"] in (WHOLE, WHOLE_TOLD, WHOLE_HOT)]
                if any(x["times"] > 1 for x in notes):
                    spans += _own_repeats(raw, length)
                done = _finish(text, words, spans, cleaned) if all(x["kind"] not in (PART, PART_HOT) for x in notes) else (None,) * 4
                ctx, win = [], []
                told = [x for x in notes if x["kind"] != WHOLE]
                hashes = _windows(raw, length).view("int64").tolist() if any(x["kind"] in (PART_HOT, WHOLE_HOT) for x in told) else []
                if len(met) > GIVEN:
                    met.clear()
                if len(sent) > GIVEN:
                    sent.clear()
                for x in told:
                    if x["kind"] == WHOLE_TOLD:
                        if (r1, r2, x["a"]) in sent:
                            continue
                        sent.add((r1, r2, x["a"]))
                    if x["kind"] in (PART, WHOLE_TOLD):
                        ctx.append({"m": x["m"], "a": x["a"], "kind": x["kind"], "words": b" ".join(words[x["a"] : x["a"] + x["n"] + length - 1]).decode("utf-8", "surrogatepass")})
                    else:
                        weight = 2 if x["kind"] == WHOLE_HOT else 1
                        for i in range(x["a"], x["a"] + x["n"]):
                            w = (x["m"], hashes[i])
                            if met.get(w, 0) > 1:  # known as repeated
                                spans.append((i, length))
                            else:
                                met[w] = met.get(w, 0) + weight
                                win.append({"m": w[0], "w": w[1], "a": i, "weight": weight})
                rows.append((*done, text if done[0] is None else None, [{"a": a, "n": n} for a, n in spans] if done[0] is None else None, ctx, win))
            yield pa.RecordBatch.from_arrays([*batch.columns[: k + 2], *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]], names=names)


def _close(batches: Iterator[pa.RecordBatch], keep: list[str], cleaned: bool) -> Iterator[pa.RecordBatch]:
    """(keep..., text, spans, found) to finished rows."""
    k = len(keep)
    for batch in batches:
        rows = [_finish(text, utf8([text])[0].split(), [(x["a"], x["n"]) for x in (spans or []) + (found or [])], cleaned) for text, spans, found in zip(*(batch.column(k + i).to_pylist() for i in range(3)), strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]], names=[*keep, *RESULT])


def remove_repeats(docs: DataFrame, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, cleaned: bool = True) -> DataFrame:
    """The kept columns with n_words, n_removed, kept_sha256 and, if asked for, the cleaned text.

    A word goes if a window of `length` words over it also starts anywhere else in the input, the same document included. Null and
    empty texts have no words and stay as they are; texts of fewer words lose nothing; repeated rows repeat each other; an empty table
    gives none. Kept columns with the result's names are replaced by it, other columns aren't read. Very long texts are read whole, one
    after the other. Counts of minimizers and contexts are summed before they are shuffled. A minimizer with over SHARD distinct
    contexts is resolved by counting windows instead, so no shard grows with the corpus.

    Contexts and windows are told apart by 128 bits of hashes, rows by 96.
    """
    spark = docs.sparkSession
    keep = [c for c in keep or [id_col] if c not in RESULT]
    scratch = Scratch(spark, "substrings")
    row = ["__r1", "__r2"]
    src = docs.select(*keep, row_key(id_col, text_col).alias("__r1"), F.hash(id_col, text_col).alias("__r2"), F.col(text_col).alias("__text"))
    occ = src.select(*row, "__text").mapInArrow(lambda it: _contexts(it, length), "m long, c long, __r1 long, __r2 int, a int, n int, times long")
    occ = scratch.save(occ, "occurrences")
    repeated = occ.groupBy("m").agg(F.sum("times").alias("total"), (F.min("c") == F.max("c")).alias("single")).where("total > 1").drop("total")
    notes = scratch.save(occ.join(repeated, "m"), "notes")
    scratch.drop("occurrences")
    mixed = notes.where("not single")
    classes = scratch.save(mixed.groupBy("m", "c").agg(F.sum("times").alias("n_same"), F.min(F.struct(*row, "a")).alias("rep")), "classes")
    hot = classes.groupBy("m").agg(F.count("*").alias("n_classes")).where(F.col("n_classes") > SHARD).select("m", F.lit(True).alias("hot"))
    classes = classes.join(hot, "m", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    same, is_rep = F.col("n_same") > 1, F.struct(*row, "a") == F.col("rep")
    kind = F.when(~same & F.col("hot"), PART_HOT).when(~same, PART).when(~is_rep, WHOLE).when(F.col("hot"), WHOLE_HOT).otherwise(WHOLE_TOLD)
    told = mixed.join(classes, ["m", "c"]).select(*row, "m", "a", "n", "times", kind.alias("kind")).union(notes.where("single").select(*row, "m", "a", "n", "times", F.lit(WHOLE)))
    told = told.distinct()  # fully repeated rows share a key and their notes; classes have counted them
    per_row = told.groupBy(*row).agg(F.collect_list(F.struct("m", "a", "n", "times", "kind")).alias("notes"))
    kept_schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    rows = src.join(per_row, row, "left").select(*keep, *row, "__text", "notes")
    state = scratch.save(rows.mapInArrow(lambda it: _resolve(it, length, keep, cleaned), f"{kept_schema}{', ' if keep else ''}__r1 long, __r2 int, {FIELDS}, {OPEN}"), "state")
    scratch.drop("notes", "classes")

    ctx = state.where(F.size("contexts") > 0).select(*row, F.explode("contexts").alias("x")).select("x.m", *row, "x.a", "x.kind", "x.words")
    found = ctx.repartition("m").sortWithinPartitions("m", *row, "a").mapInArrow(lambda it: _shards(it, length), "__r1 long, __r2 int, a int, n int")
    win = state.where(F.size("windows") > 0).select(*row, F.explode("windows").alias("x")).select(*row, "x.m", "x.w", "x.a", "x.weight")
    twice = win.groupBy("m", "w").agg(F.sum("weight").alias("n")).where("n > 1").select("m", "w")
    found = found.union(win.where("weight = 1").join(twice, ["m", "w"], "left_semi").select(*row, "a", F.lit(length)))
    # a row that is repeated whole has its spans once for each of its copies
    spans = found.distinct().groupBy(*row).agg(F.collect_list(F.struct("a", "n")).alias("found"))
    late = state.where("open is not null").select(*keep, *row, "open", "spans").join(spans, row, "left").select(*keep, "open", "spans", "found")
    closed = late.mapInArrow(lambda it: _close(it, keep, cleaned), f"{kept_schema}{', ' if keep else ''}{FIELDS}")
    return state.where("open is null").select(*keep, *RESULT).union(closed)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), cleaned=False).drop("cleaned")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS p, len(ws) AS n FROM d),
g AS (SELECT *, p <= n - 34 AS whole, string_agg(word, ' ') OVER (PARTITION BY rid ORDER BY p ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS win FROM w),
c AS (SELECT rid, p, word, whole AND count(*) OVER (PARTITION BY win, whole) > 1 AS again FROM g),
k AS (SELECT rid, p, word, max(CASE WHEN again THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM c),
s AS (SELECT rid, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (gone = 0) AS stay FROM k GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(stay, '')) AS kept_sha256 FROM d LEFT JOIN s USING (rid)
"""
