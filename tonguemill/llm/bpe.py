"""Byte-level BPE by backtracking over longest matches.

Bytes are Latin-1 characters for the Aho-Corasick automaton of all tokens. From the longest token at a place the encoder steps to
shorter ones, or back, until each neighbouring pair is one that the merges themselves could have left side by side; pair checks
are memoised and places that led nowhere are marked, so the work is linear in the text and the ids are exactly the merges' ids.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonguemill.llm.common import spread, table, worker_cache

#: Entries of a Python worker's caches of words (in each of two generations) and pieces, and the characters from which none is kept.
CACHE_WORDS, LONG = 300_000, 64


class BytePairEncoder:
    """Ranks of a vocabulary file with the tables for backtracking: how each token was merged, and its next shorter prefix token."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ids = {base64.b64decode(t).decode("latin-1"): int(i) for t, i in pairs}
        n = max(self.ids.values()) + 1
        self.text: list[str] = [""] * n
        for t, i in self.ids.items():
            self.text[i] = t
        self.flat = np.frombuffer("".join(self.text).encode("latin-1"), "uint8")  # the bytes of all tokens
        self.sizes = np.fromiter(map(len, self.text), "int64", n)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.pattern = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        self.shorter = [self._prefix(t) for t in self.text]
        self.left, self.right = list(range(n)), list(range(n))
        self.merged: dict[tuple[int, int], int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        for i, t in enumerate(self.text):
            if len(t) > 1:
                a = self.shorter[i]
                while a >= 0:
                    b = self.ids.get(t[len(self.text[a]) :], n)
                    if a < i and b < i and self._side_by_side(a, b):
                        self.left[i], self.right[i], self.merged[a, b] = a, b, i
                        break
                    a = self.shorter[a]
        self.fits.clear()
        self.pieces: dict[str, list[int]] = {}
        self.inner: dict[str, bytes] = {}  # words with a blank before them
        self.old: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}  # words at the start of a line

    def _prefix(self, t: str) -> int:
        for k in range(len(t) - 1, 0, -1):
            if t[:k] in self.ids:
                return self.ids[t[:k]]
        return -1

    def _side_by_side(self, a: int, b: int) -> bool:
        """Whether the merges leave a and b as they are when they meet: undoes the later merge first and looks for an earlier one across."""
        bound = len(self.text)
        while True:
            if self.merged.get((a, b), bound) < bound:
                return False
            if a > b:
                bound = a
                if self.left[a] != a:
                    a = self.right[a]
                    continue
                bound = b + 1
                if self.left[b] == b:
                    return True
                b = self.left[b]
            else:
                bound = b + 1
                if self.left[b] != b:
                    b = self.left[b]
                    continue
                bound = a
                if self.left[a] == a:
                    return True
                a = self.right[a]

    def encode_bytes(self, s: str) -> list[int]:
        """Ids of one piece given as Latin-1."""
        whole = self.ids.get(s)
        if whole is not None:
            return [whole]
        n = len(s)
        longest = [0] * n
        for end, (i, k) in self.automaton.iter(s):
            longest[end - k + 1] = i  # ends ascend, so the longest stays
        dead = bytearray(n + 1)
        out: list[int] = []
        starts: list[int] = []
        at, token, fits, shorter, text = 0, longest[0], self.fits, self.shorter, self.text
        while at < n:
            while token >= 0:
                end = at + len(text[token])
                if not dead[end]:
                    if not out:
                        break
                    pair = (out[-1], token)
                    ok = fits.get(pair)
                    if ok is None:
                        ok = fits[pair] = self._side_by_side(*pair)
                    if ok:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                starts.append(at)
                at = end
                token = longest[at] if at < n else -1
            else:
                dead[at] = 1
                token = shorter[out.pop()]
                at = starts.pop()
        if len(fits) > 2_000_000:
            fits.clear()
        return out

    def _whole(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        ids: list[int] = []
        pieces = self.pieces
        for piece in self.pattern.findall(text):
            own = pieces.get(piece)
            if own is None:
                own = self.encode_bytes(piece.encode("utf-8", "surrogatepass").decode("latin-1"))
                if len(piece) < LONG:
                    if len(pieces) >= CACHE_WORDS:
                        pieces.clear()
                    pieces[piece] = own
            ids += own
        return array("i", ids).tobytes()

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, put together from those of their words, which are kept.

        Where all white space is single blanks and line ends, a match of the pattern never holds what stands on both sides of a blank or
        a line end, and a blank goes with the word that follows it. Other texts are encoded whole.
        """
        split: list[list[list[str]] | None] = []
        heads: set[str] = set()
        rest: set[str] = set()
        for t in texts:
            plain = t.replace("\n", " ")
            if not t or " ".join(plain.split()) != plain:
                split.append(None)
                continue
            own = [x.split(" ") for x in t.split("\n")]
            split.append(own)
            for ws in own:
                heads.add(ws[0])
                rest.update(ws)
        inner, first, old = self.inner, self.first, self.old
        for w in rest.difference(inner):
            inner[w] = old.get(w) or self._whole(" " + w)
        for w in heads.difference(first):
            first[w] = self._whole(w)
        line_end, known, out = self._whole("\n"), inner.__getitem__, []
        for t, own in zip(texts, split, strict=True):
            if own is None:
                out.append(self._whole(t))
                continue
            parts = []
            for ws in own:
                parts += (line_end, first[ws[0]])
                parts += map(known, ws[1:])
            out.append(b"".join(parts[1:]))
        for cache, used in ((inner, rest), (first, heads)):
            for w in [w for w in used if len(w) >= LONG]:
                del cache[w]
        if len(inner) > CACHE_WORDS:
            self.old, self.inner = inner, {}
        if len(first) > CACHE_WORDS // 4:
            self.first = {}
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed([text])[0], "<i4").tolist()

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, where each text ends) of several texts' ids."""
        sizes = self.sizes[ids]
        ends = np.append(0, np.cumsum(sizes))
        return self.flat[spread(self.starts[ids], sizes)], ends[np.cumsum(counts)]


def encoder(path: str) -> BytePairEncoder:
    """One for each Python worker and file."""
    return worker_cache(("bpe", path), lambda: BytePairEncoder(path))


def _slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)


def encode_texts(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with the ids of the whole text in place of the text; null is the empty text. Row by row: no key, no shuffle.

    Repeated rows are encoded each, very long texts whole; an empty table gives none. Columns of the input stay, but for the text and
    any named like the ids.
    """
    keep = [c for c in docs.columns if c not in (text_col, ids_col)]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"`{ids_col}` array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for whole in batches:
            for batch in _slices(whole, 200):
                packed = bpe.encode_packed([t or "" for t in batch.column(len(keep)).to_pylist()])
                offsets = np.cumsum([0] + [len(p) // 4 for p in packed]).astype("int32")
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], ids], names=[*keep, ids_col])

    return docs.select(*keep, text_col).mapInArrow(run, schema)


def decode_ids(docs: DataFrame, path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """docs with the bytes of the ids added; null and empty ids give no bytes. Row by row: repeated rows are decoded each, an empty
    table gives none. A column of the input named like the bytes is replaced."""
    keep = [c for c in docs.columns if c != bytes_col]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"`{bytes_col}` binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for whole in batches:
            for batch in _slices(whole, 200):
                lists = batch.column(keep.index(ids_col))
                counts = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), "int64")
                data, ends = bpe.decode(np.asarray(lists.flatten()), counts)
                got = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(np.append(0, ends)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([*batch.columns, got.cast(pa.binary())], names=[*keep, bytes_col])

    return docs.select(*keep).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = decode_ids(encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), path), path)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
