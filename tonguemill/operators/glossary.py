"""Translation by a glossary: terms of one or more words, the longest that stands at a place.

Words are runs of letters and digits. A term's words may be parted by any blanks and tabs, by nothing else; case counts. Going through a
text from its start, the longest term that begins at a word is replaced and the search goes on behind it. All else stays.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonguemill.core.config import JobConfig
from tonguemill.functions.scalars import let
from tonguemill.operators.translation import KEY

#: Bytes of terms and translations that may be sent to every task.
BROADCAST = 16 << 20
WORD = r"[\p{L}\p{N}]+"
_WORD = re.compile(r"[^\W_]+")


def clean_terms(terms: DataFrame) -> DataFrame:
    """(term, translation, words): one row for each term, its words joined by single blanks. Of several translations the first in order
    stays; null translations and terms without a word, or with other marks between words, are left out."""
    bare = F.trim(F.regexp_replace("term", r"[ \t]+", " "))
    rows = terms.select(bare.alias("term"), "translation").where(F.col("term").rlike(rf"\A{WORD}(?: {WORD})*\z") & F.col("translation").isNotNull())
    return rows.groupBy("term").agg(F.min("translation").alias("translation")).withColumn("words", F.size(F.split("term", " ")))


def build_trie(rows: list[tuple[str, str]]) -> dict:
    """Nested by words; the empty word holds a term's translation."""
    root: dict = {}
    for term, translation in rows:
        at = root
        for word in term.split(" "):
            at = at.setdefault(word, {})
        at[""] = translation
    return root


def replace_terms(text: str, trie: dict) -> str:
    words = [m.span() for m in _WORD.finditer(text)]
    out, done, i = [], 0, 0
    while i < len(words):
        at, end, told, j = trie, 0, None, i
        while j < len(words) and (j == i or not text[words[j - 1][1] : words[j][0]].strip(" \t")):
            at = at.get(text[words[j][0] : words[j][1]])
            if at is None:
                break
            j += 1
            if "" in at:
                end, told = j, at[""]
        if told is None:
            i += 1
            continue
        out += [text[done : words[i][0]], told]
        done, i = words[end - 1][1], end
    return "".join([*out, text[done:]])


def _in_place(batches: DataFrame, trie: dict) -> DataFrame:
    """Each batch by itself, with the trie in every task; no shuffle."""
    shared, kind = batches.sparkSession.sparkContext.broadcast(trie), batches.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in parts:
            told = [[replace_terms(t, shared.value) for t in texts] for texts in rows.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(told, pa.list_(pa.string()))], names=["doc_id", "part", "batch_id", "translations"])

    return batches.select(*KEY, "batch_id", F.transform("items", lambda i: i["text"]).alias("texts")).mapInArrow(run, f"doc_id {kind}, part string, batch_id int, translations array<string>")


def _runs(text: Column, longest: int) -> Column:
    """(k, w, term) of every run of up to `longest` words of a text; k is the first word's place among words and what is between them."""

    def at(ps: Column) -> Column:
        def of(k: Column) -> Column:
            # how many words hang together from here, by blanks only
            zero = F.struct(F.lit(0).alias("n"), F.lit(True).alias("open"))
            step = lambda acc, w: let(acc["open"] & ((w == 0) | F.get(ps, k + 2 * w - 1).rlike(r"\A[ \t]+\z")) & F.get(ps, k + 2 * w).isNotNull(), lambda ok: F.struct((acc["n"] + ok.cast("int")).alias("n"), F.coalesce(ok, F.lit(False)).alias("open")))
            n = F.aggregate(F.sequence(F.lit(0), F.lit(longest - 1)), zero, step, lambda acc: acc["n"])
            term = lambda w: F.array_join(F.transform(F.sequence(F.lit(0), w - 1), lambda j: F.get(ps, k + 2 * j)), " ")
            return F.transform(F.sequence(F.lit(1), n), lambda w: F.struct(k.alias("k"), w.alias("w"), term(w).alias("term")))

        firsts = F.filter(F.sequence(F.lit(0), F.size(ps) - 1), lambda k: F.get(ps, k).rlike(rf"\A{WORD}\z"))
        return F.when(F.size(ps) > 0, F.flatten(F.transform(firsts, of)))

    return let(_pieces(text), at)


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"({WORD}|[^\p{{L}}\p{{N}}]+)"), F.lit(1))


def _by_join(batches: DataFrame, terms: DataFrame, longest: int) -> DataFrame:
    """Runs of words meet the terms in a join; only runs that are terms go on, and meet their batch. What is between words is in no join."""
    texts = batches.select(*KEY, "batch_id", F.posexplode("items").alias("at", "i"))
    runs = texts.select(*KEY, "batch_id", "at", F.explode(_runs(F.col("i.text"), longest)).alias("r")).select(*KEY, "batch_id", "at", "r.k", "r.w", "r.term")
    hits = runs.join(terms.select("term", "translation"), "term").groupBy(*KEY, "batch_id").agg(F.sort_array(F.collect_list(F.struct("at", "k", (-F.col("w")).alias("shorter"), "translation"))).alias("hits"))
    taken = "array<struct<at:int,k:int,until:int,t:string>>"

    def step(acc: Column, h: Column) -> Column:
        last = F.element_at(acc, -1)
        free = (F.size(acc) == 0) | (last["at"] < h["at"]) | (last["until"] <= h["k"])
        return F.when(free, F.array_append(acc, F.struct(h["at"].alias("at"), h["k"].alias("k"), (h["k"] - 2 * h["shorter"] - 1).alias("until"), h["translation"].alias("t")))).otherwise(acc)

    def told(item: Column, at: Column, hits: Column) -> Column:
        own = F.filter(hits, lambda h: h["at"] == at)

        def piece(p: Column, k: Column) -> Column:
            here = lambda of: F.exists(of, lambda h: (h["k"] <= k) & (k < h["until"]))
            begins = let(own, lambda of: F.get(F.filter(of, lambda h: h["k"] == k), F.lit(0))["t"])
            return F.when(begins.isNotNull(), begins).when(here(own), F.lit("")).otherwise(p)

        return F.array_join(F.transform(_pieces(item["text"]), piece), "")

    rows = batches.join(hits, [*KEY, "batch_id"], "left").withColumn("hits", F.aggregate(F.coalesce("hits", F.array()), F.array().cast(taken), step))
    translations = F.transform("items", lambda i, at: told(i, at, F.col("hits")))
    return rows.select(*KEY, "batch_id", translations.alias("translations"))


def glossary(terms: DataFrame, broadcast: int = BROADCAST) -> Callable[[DataFrame, JobConfig], DataFrame]:
    """A translator by a table (term, translation). Up to `broadcast` bytes of terms go to every task; more meet the texts in a join. Both give
    the same."""

    def run(batches: DataFrame, config: JobConfig) -> DataFrame:
        clean = clean_terms(terms)
        size = clean.agg(F.sum(F.octet_length("term") + F.octet_length("translation")).alias("n"), F.max("words").alias("longest")).first()
        if (size.n or 0) <= broadcast:
            rows = clean.select("term", "translation").toArrow().to_pydict()
            told = _in_place(batches, build_trie(list(zip(rows["term"], rows["translation"], strict=True))))
        else:
            told = _by_join(batches, clean, size.longest)
        return told.withColumn("error", F.lit(None).cast("string"))

    return run
