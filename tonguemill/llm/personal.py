"""Personal data by bootstrapped contextual extraction.

Base identifiers (e-mail, IP, card and phone in their plain forms) are the seeds. What stands before them on a line, one to three words,
gives lexical patterns; other forms of identifiers (spelt-out addresses, ungrouped or domestic numbers, IPv6) are candidates. Patterns
and instances form a graph: a pattern is as good as the share of its places in the corpus that believed instances fill, an instance is
believed as far as its patterns are good. Spark scores both sides in turns; the places of good patterns are then personal data, too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonguemill.llm.common import Scratch, run_hashes, table, word_hashes

#: In the order of results.
KINDS = ("email", "ip", "card", "phone")
#: Turns of scoring; share of a pattern's places that must be filled by believed instances, and how many different ones.
ROUNDS, CONFIDENT, SUPPORT = 4, 0.8, 3
#: Words of a pattern, bytes of a word at most, and characters of a line that are looked at before an identifier.
WORDS, LONGEST, BEFORE = 3, 40, 200
#: Places of the table by which texts are searched for patterns, 4 MB as broadcast; more patterns only make more rows to drop in a join.
SLOTS = 1 << 22
#: Bytes of texts that are hashed at once, about; a longer text is hashed alone.
STRETCH = 1 << 20

# The base forms, e-mails apart. A lookbehind and possessive repeats keep long runs linear and change no match that counts.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Other forms that a context can tell to be an identifier.
_NUMBER = re.compile(r"(?<![0-9A-Za-z])[0-9]++(?:[ ./()-]{1,2}[0-9]++)*(?![0-9A-Za-z])")
_AT, _DOT = r"(?: ?[\[({]at[\])}] ?|@| at )", r"(?: ?[\[({]dot[\])}] ?| dot |\.)"
_SPELT = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}})+", re.I)
_SPELT_MARK = re.compile(r"[\[({]at[\])}]|[\[({]dot[\])}]| dot ", re.I)
_IP_PARTS = re.compile(r"(?<![0-9])[0-9]{1,3}(?: ?[\[(](?:\.|dot)[\])] ?[0-9]{1,3}){3}(?![0-9])", re.I)
_IPV6 = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Za-z:])")

#: Words of contexts: A-Z to a-z, digits to 0, marks away, a line's start a word of its own.
_FOLD = bytes(i + 32 if 65 <= i <= 90 else 48 if 48 <= i <= 57 else i for i in range(256))
_MARKS = b"()[]{}\"'<>,;.!?*_`|^"


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    """Whether the check digit fits: every second digit from the right is doubled, and its digits added."""
    total = sum(ord(c) - 48 for c in digits[::-2])
    return (total + sum(sum(divmod(2 * (ord(c) - 48), 10)) for c in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local part, @ and domain, from each @ to both sides, so a long run without one costs nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) of the base identifiers, by kind, then start; leftmost and apart within a kind."""
    out = [(0, a, b) for a, b in _emails(text)]
    if re.search("[0-9]", text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((1, *m.span()))
        for m in _CARD.finditer(text):
            d = _digits(m[0]) if len(m[0]) <= 40 else ""
            if 16 <= len(d) <= 19 and luhn(d):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) of other forms that no base identifier overlaps; a number may be of two kinds."""
    found = []
    if _SPELT_MARK.search(text):
        found += [(0, *m.span()) for m in _SPELT.finditer(text)]
    found += [(1, *m.span()) for p in (_IP_PARTS, _IPV6) for m in p.finditer(text)]
    for m in _NUMBER.finditer(text):
        n = len(_digits(m[0])) if len(m[0]) <= 60 else 0
        found += [(k, *m.span()) for k, few, many in ((2, 12, 19), (3, 7, 15)) if few <= n <= many]
    if not found:
        return []
    held = sorted((a, b) for _, a, b in taken)
    starts, ends = [a for a, _ in held], np.maximum.accumulate([b for _, b in held]) if held else []
    free = lambda a, b: not (i := int(np.searchsorted(starts, b))) or ends[i - 1] <= a  # noqa: E731  what begins before b has ended by a
    return sorted(c for c in set(found) if free(c[1], c[2]))


def context(text: str, start: int) -> list[bytes]:
    """Up to WORDS words on the line before `start`, the last one last; `^` stands for the line's start. Long words end it."""
    begin = max(0, start - BEFORE)
    line = text.rfind("\n", begin, start) + 1
    head = text[max(begin, line) : start].encode("utf-8", "surrogatepass").translate(_FOLD, _MARKS)
    words = head.split()
    if line or not begin:
        words.insert(0, b"^")
    elif words:
        words.pop(0)  # it may be cut
    out: list[bytes] = []
    for w in reversed(words[-WORDS:]):
        if len(w) > LONGEST:
            break
        out.insert(0, w)
    return out


def _hashes(words: list[bytes]) -> np.ndarray:
    return word_hashes([b" ".join(words)])[0]


def patterns(text: str, start: int) -> list[tuple[bytes, int]]:
    """(words, 64-bit hash) of the patterns before a place: its last word, its last two, its last three. A line's start alone is none."""
    own = context(text, start)
    h = _hashes(own) if own else ()
    return [(b" ".join(own[-k:]), int(run_hashes(h[-k:], k).astype("int64")[0])) for k in range(1, len(own) + 1) if own[-k:] != [b"^"]]


def instance(kind: int, text: str) -> str:
    """What tells an identifier from another: its digits, or its letters without marks and spelt-out separators."""
    if kind == 0:
        return re.sub(r"[\[({]at[\])}]| at ", "@", re.sub(r"[\[({]dot[\])}]| dot ", ".", text.lower())).replace(" ", "")
    return re.sub(r"[\[( ](?:dot|\.)[\]) ]", ".", text.lower()).replace(" ", "") if kind == 1 else _digits(text)


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
_FOUND = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("seed", pa.bool_()), ("instance", pa.string()), ("patterns", pa.list_(pa.struct([("words", pa.string()), ("hash", pa.int64())])))])
SPAN = "struct<kind:int,start:long,end:long>"
FOUND = "struct<kind:int,start:long,end:long,seed:boolean,instance:string,patterns:array<struct<words:string,hash:long>>>"


def _find(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, found = [], []
        for raw in batch.column(len(names)).to_pylist():
            text = raw or ""
            own = base_spans(text)
            base.append([{"kind": k, "start": a, "end": b} for k, a, b in own])
            rows = []
            for seed, spans in ((True, own), (False, candidates(text, own))):
                for k, a, b in spans:
                    told = [{"words": w.decode("utf-8", "replace"), "hash": h} for w, h in patterns(text, a)]
                    rows.append({"kind": k, "start": a, "end": b, "seed": seed, "instance": instance(k, text[a:b]), "patterns": told})
            found.append(rows)
        yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(base, pa.list_(_SPAN)), pa.array(found, pa.list_(_FOUND))], names=[*names, "base", "found"])


def find_base(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with base (spans) and found (seeds and candidates with their patterns and instances), row by row."""
    names = [f"k{i}" for i in range(len(keep))]
    schema = ", ".join([f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True)] + [f"base array<{SPAN}>, found array<{FOUND}>"])
    rows = docs.select(*[F.col(c).alias(n) for n, c in zip(names, keep, strict=True)], F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda it: _find(it, names), schema)


def _places(batches: Iterator[pa.RecordBatch], slots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(hash, n): how often the words of a pattern, and some others that share its slot, stand in texts; sums of a batch."""

    def counted(raw: list[bytes]) -> Iterator[pa.RecordBatch]:
        h, n = word_hashes(raw)
        ends = np.repeat(np.cumsum(n), n)
        hit = []
        for k in range(1, WORDS + 1):
            runs = run_hashes(h, k)
            inside = np.arange(k, len(h) + 1) <= ends[: len(runs)] if len(runs) else np.zeros(0, bool)
            runs = runs[inside]
            hit.append(runs[slots[(runs % np.uint64(SLOTS)).astype("int64")]])
        own, n = np.unique(np.concatenate(hit), return_counts=True)
        if len(own):
            yield pa.RecordBatch.from_arrays([pa.array(own.astype("int64")), pa.array(n)], names=["hash", "n"])

    for batch in batches:
        held, size = [], 0
        for raw in batch.column(0).to_pylist():
            # a line's start is a word; marks inside are gone before, so none is taken for it
            held.append(b"^ " + raw.translate(_FOLD, _MARKS).replace(b"\n", b" ^ "))
            size += len(held[-1])
            if size > STRETCH:
                yield from counted(held)
                held, size = [], 0
        yield from counted(held)


def learn_patterns(docs: DataFrame, found: DataFrame, scratch: Scratch, text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(kind, words, instances, places, score) of every pattern that some candidate stands in, from find_base's rows.

    Only such patterns can discover anything, so only theirs are scored. score is the share of a pattern's places in the corpus that
    believed instances fill: seeds are believed whole, a candidate is 1 minus the product of its patterns' doubts. Sums over patterns and
    over instances are partial before they are shuffled, so a word that a third of all identifiers follow is no hot key.
    """
    each = found.select(F.explode("found").alias("f")).select("f.kind", "f.instance", "f.seed", F.explode("f.patterns").alias("p"))
    edges = each.groupBy("kind", "p.words", "p.hash", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("n"))
    edges = scratch.save(edges, "edges")
    some = edges.groupBy("kind", "words", "hash").agg(F.count("*").alias("instances"), F.bool_and("seed").alias("known"), F.sum("n").alias("own"))
    some = scratch.save(some.where((F.col("instances") >= SUPPORT) & ~F.col("known")).drop("known"), "patterns")
    slot = lambda h: F.pmod(h, F.lit(SLOTS)).cast("int")
    taken = some.select(slot(F.col("hash")).alias("slot")).distinct().toArrow()["slot"].to_numpy()
    if not len(taken):
        return some.select("kind", "words", "instances", F.col("own").alias("places"), F.lit(0.0).alias("score"))
    slots = np.zeros(SLOTS, bool)
    slots[taken] = True
    shared = docs.sparkSession.sparkContext.broadcast(slots)
    text = docs.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    places = text.mapInArrow(lambda it: _places(it, shared.value), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("places"))
    # an identifier may begin within a word, where its context doesn't count as a place of whole words
    scored = some.join(places, "hash", "left").select("kind", "words", "instances", F.greatest("own", F.coalesce("places", F.lit(0))).alias("places"))
    scored = scratch.save(scored, "places")
    core = scratch.save(edges.join(scored, ["kind", "words"]).select("kind", "words", "instance", "seed", "n", "places"), "core")
    belief = F.when(F.col("seed"), 1.0).otherwise(0.0)
    now = core.withColumn("belief", belief)
    for k in range(rounds):
        pattern = now.groupBy("kind", "words").agg((F.sum(F.col("n") * F.col("belief")) / F.max("places")).alias("score"), F.count_if(F.col("belief") > 0.5).alias("believed"))
        good = F.when(F.col("believed") >= SUPPORT, F.col("score")).otherwise(0.0)
        pattern = scratch.save(pattern.withColumn("score", good), f"score{k}")
        if k < rounds - 1:
            doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))
            told = core.where("not seed").join(pattern, ["kind", "words"]).groupBy("kind", "instance").agg((1 - doubt).alias("told"))
            now = core.join(told, ["kind", "instance"], "left").withColumn("belief", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("told", F.lit(0.0))))
            now = scratch.save(now.drop("told"), f"belief{k}")
    return scored.join(pattern.select("kind", "words", "score"), ["kind", "words"])


def find_personal_data(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), confident: float = CONFIDENT) -> DataFrame:
    """The kept columns with base and discovered: arrays of spans (kind, start, end) in code points, each by kind and start.

    Null and empty texts have none; repeated rows are searched each; very long texts are searched whole, in linear time; an empty table
    gives none. A candidate that good patterns of two kinds precede is of the kind with the better one, the earlier kind where they tie.
    Candidates that overlap each other are all reported. Only `keep` and the text are read; `base` and `discovered` in keep are refused.

    Rows are searched each by themselves. The graph, which has no texts, is written to the shared folder, as are the rows' spans; only
    candidates in good places meet them in a join.
    """
    if clash := {"base", "discovered"} & set(keep):
        raise ValueError(f"keep holds names of the result: {sorted(clash)}")
    scratch = Scratch(docs.sparkSession, "personal")
    found = scratch.save(find_base(docs, text_col, keep).withColumn("__row", F.monotonically_increasing_id()), "found")
    names = [f"k{i}" for i in range(len(keep))]
    good = learn_patterns(docs, found, scratch, text_col).where(F.col("score") >= confident).select("kind", "words", "score")
    loose = found.select("__row", F.explode(F.filter("found", lambda f: ~f["seed"])).alias("f")).select("__row", "f.kind", "f.start", "f.end", F.explode("f.patterns.words").alias("words"))
    hits = loose.join(good, ["kind", "words"]).groupBy("__row", "start", "end").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
    spans = hits.groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("discovered"))
    none = F.array().cast(f"array<{SPAN}>")
    told = found.select(*names, "__row", "base").join(spans, "__row", "left")
    return told.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "base", F.coalesce("discovered", none).alias("discovered"))


def as_text(spans):
    """kind:start:end of spans in their order, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = find_personal_data(table(spark, sf_dir, "documents"))
    is_of = lambda kind: lambda s: s["kind"] == kind
    count = [F.size(F.filter("base", is_of(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    every = F.sort_array(F.concat("base", "discovered"))
    return told.select("doc_id", *count, F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(every).alias("spans"), F.size("discovered").cast("long").alias("n_discovered"))
