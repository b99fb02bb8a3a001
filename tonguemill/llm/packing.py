"""Best-fit packing of tokenized documents into sequences, by hierarchical residual packing.

Every partition packs its pieces best-fit, largest first, and emits the bins that are nearly full. The underfull bins become items
of the next round, on an eighth of the partitions, and so on up a tree; bins are merged whole, so a piece's place is the sum of the
offsets on its way up.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer

from tonguemill.llm.common import Scratch, table, worker_cache

LENGTH, END_ID = 1024, 2
#: Bins with no more room than this leave the rounds.
NEARLY_FULL = 4
#: Items that one task packs at once; more are packed in turns, and more open bins than this are dealt over more tasks.
ITEMS = 100_000
#: Partitions whose underfull bins meet in one of the next round.
FANOUT = 8


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it can be seen, else the next from U+0100 on."""
    seen = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in seen} | {chr(0x100 + i): b for i, b in enumerate(sorted(set(range(256)) - set(seen)))}


class TextIds:
    """Ids of the tokenizers library for whole texts, as little-endian 32-bit integers.

    A byte-level BPE without further settings, whose merges stand in the order of their ids, is what the tiktoken library computes too,
    in a quarter of the time, from the same vocabulary; it is then used for texts that hold no special token. All else goes to tokenizers.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, cut = told["model"], told["pre_tokenizer"] or {}
        vocab = model["vocab"]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        plain &= cut.get("type") == "ByteLevel" and cut.get("use_regex", False) and not cut.get("add_prefix_space", True) and not told["normalizer"] and not told["truncation"] and not told["padding"]
        merged = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]] if plain else []
        self.fast = None
        if plain and -1 not in merged and merged == sorted(set(merged)):
            byte = byte_characters()
            ranks = {bytes(map(byte.__getitem__, t)): i for t, i in vocab.items() if t not in self.special}
            self.fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[bytes]:
        slow = [t for t in texts if not self.fast or any(s in t for s in self.special)]
        whole = iter([e.ids for e in self.tokenizer.encode_batch_fast(slow, add_special_tokens=False)])
        left = set(slow)
        return [array("i", next(whole) if t in left else self.fast.encode_ordinary(t)).tobytes() for t in texts]


def text_ids(path: str) -> TextIds:
    return worker_cache(("packing", path), lambda: TextIds(path))


class BestFit:
    """Open bins by their room; `room` has a bit for each room that a bin has, so the least that is enough is one bit operation."""

    def __init__(self, length: int, first: int):
        self.length, self.next, self.open, self.room = length, first, {}, 0

    def put(self, size: int) -> tuple[int, int]:
        """(bin, offset) of an item in the fullest bin that takes it, else in a new one."""
        fits = self.room >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            bins = self.open[left]
            bin_ = bins.pop()
            if not bins:
                self.room &= ~(1 << left)
        else:
            left, bin_ = self.length, self.next
            self.next += 1
        if left > size:
            self.open.setdefault(left - size, []).append(bin_)
            self.room |= 1 << (left - size)
        return bin_, self.length - left

    def close(self, most: int) -> list[tuple[int, int]]:
        """(bin, fill) of the bins with more room than `most`; the bins are given away."""
        out = [(b, self.length - left) for left, bins in sorted(self.open.items()) if left > most for b in bins]
        self.open, self.room = {}, 0
        return out

    def roomy(self, most: int) -> set[int]:
        return {b for left, bins in self.open.items() if left > most for b in bins}


def _first_bin(round_: int) -> int:
    """Bins of all tasks of all rounds have numbers of their own."""
    return round_ << 57 | TaskContext.get().partitionId() << 36


def cut_lengths(n: int, length: int = LENGTH) -> list[int]:
    """Lengths of a document's pieces: all of `length` but the first, which is what is left."""
    full, first = divmod(n, length)
    return [first] * (first > 0) + [length] * full


PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long, bin long, at long, open boolean"


def _pack_partition(batches: Iterator[pa.RecordBatch], path: str, length: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows of pieces with their bin and place and whether the bin may have room, and rows of underfull bins (piece -1, length: their
    fill)."""
    tok, fit = text_ids(path), BestFit(length, _first_bin(0))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "at", "open"]
    kinds = [id_type, pa.int32(), *[pa.int64()] * 5, pa.bool_()]
    rows: list[tuple] = []
    small: list[int] = []  # rows to pack

    def give(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True) if done else [[]] * 8, kinds, strict=True)], names=names)

    def pack() -> Iterator[pa.RecordBatch]:
        small.sort(key=lambda i: -rows[i][3])
        for i in small:
            rows[i] += fit.put(rows[i][3])
        roomy = fit.roomy(NEARLY_FULL)
        yield give([(*r, r[5] in roomy) for r in rows])
        rows.clear()
        small.clear()
        if len(roomy) > ITEMS:
            yield left()

    def left() -> pa.RecordBatch:
        return give([(None, -1, None, n, None, b, None, None) for b, n in fit.close(NEARLY_FULL)])

    for whole in batches:
        for a in range(0, whole.num_rows, 500):
            batch = whole.slice(a, 500)
            packed = tok.encode([t or "" for t in batch.column(1).to_pylist()])
            for doc, ids in zip(batch.column(0).to_pylist(), packed, strict=True):
                ids += END_ID.to_bytes(4, "little")
                start = 0
                for piece, n in enumerate(cut_lengths(len(ids) // 4, length)):
                    row = (doc, piece, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]))
                    if n == length:
                        rows.append((*row, fit.next, 0))
                        fit.next += 1
                    else:
                        small.append(len(rows))
                        rows.append(row)
                    start += n
            if len(rows) >= ITEMS:
                yield from pack()
    if rows:
        yield from pack()
    yield left()


def _merge(batches: Iterator[pa.RecordBatch], length: int, round_: int) -> Iterator[pa.RecordBatch]:
    """Items (bin, fill) to rows (bin, parent, at), and rows of the underfull parents (bin null, at: their fill)."""
    fit = BestFit(length, _first_bin(round_))

    def give(own: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*own, strict=True) if own else [[]] * 3)], names=["bin", "parent", "at"])

    def pack(items: list[tuple[int, int]]) -> pa.RecordBatch:
        return give([(b, *fit.put(n)) for n, b in sorted(((n, b) for b, n in items), reverse=True)])

    def left() -> pa.RecordBatch:
        return give([(None, b, n) for b, n in fit.close(NEARLY_FULL)])

    items: list[tuple[int, int]] = []
    for batch in batches:
        items += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        if len(items) >= ITEMS:
            yield pack(items)
            items = []
            if len(fit.roomy(NEARLY_FULL)) > ITEMS:
                yield left()
    yield pack(items)
    yield left()


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """A row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the ids of its whole text and END_ID; null and empty texts are END_ID alone. Documents of over `length` ids are
    cut, the rest stay whole. Repeated rows are packed each, also those without id; an empty table gives no rows. Extra columns are not
    read, whatever their names. No key is involved, so none can be hot. The driver gets counts only.

    A task packs ITEMS pieces at once and keeps its open bins for the next ones, so its rows are in the best order by such turns only.
    A bin leaves the rounds when it is nearly full or has no room for the emptiest of all others. Rounds go up to a single task; only
    where more than ITEMS bins are left do they stay dealt over several, and end with one that saves less than 1 % of these bins.
    Each round is written to the shared folder; the chain of bins is resolved before the pieces are joined with it, once, and
    only the pieces in bins that had room.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    id_type = docs.schema[id_col].dataType
    kind = to_arrow_type(id_type)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    packed = scratch.save(rows.mapInArrow(lambda it: _pack_partition(it, path, length, kind), PIECES.format(id=id_type.simpleString())), "pieces")
    items = packed.where("piece = -1").select("bin", F.col("length").alias("fill"))
    n, least, parts = items.agg(F.count("*"), F.min("fill"), F.countDistinct(F.shiftright("bin", 36))).first()
    up, k = None, 0  # bin of the first round -> the bin that it is in at last, and its place there
    while n > 1:
        k, before = k + 1, parts
        parts = max(1, parts // FANOUT, -(-n // ITEMS))
        items = items.where(F.col("fill") + least <= length).repartition(parts, F.xxhash64("bin", F.lit(k)))
        merged = scratch.save(items.mapInArrow(lambda it, r=k: _merge(it, length, r), "bin long, parent long, at long"), f"round{k}")
        links = merged.where("bin is not null")
        if up is None:
            up = links
        else:
            links = links.select(F.col("bin").alias("parent"), F.col("parent").alias("next"), F.col("at").alias("more"))
            up = up.join(links, "parent", "left").select("bin", F.coalesce("next", "parent").alias("parent"), (F.col("at") + F.coalesce("more", F.lit(0))).alias("at"))
        items = merged.where("bin is null").select(F.col("parent").alias("bin"), F.col("at").alias("fill"))
        had = n
        n, least = items.agg(F.count("*"), F.min("fill")).first()
        if before == 1 or parts == 1 or (parts >= before and n > 0.99 * had):
            break
    pieces = packed.where("piece >= 0").select("doc_id", "piece", "start", "length", "ids_crc32", "bin", "at", "open")
    placed = pieces.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    if up is not None:
        moved = pieces.where("open").join(up.select("bin", "parent", F.col("at").alias("more")), "bin", "left")
        moved = moved.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("parent", "bin").alias("sequence_id"), (F.col("at") + F.coalesce("more", F.lit(0))).alias("offset"))
        placed = pieces.where("not open").select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("at").alias("offset")).union(moved)
    return placed.withColumnRenamed("doc_id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
