"""License scans: fuzzy search for short notices.

A notice with at most k edits keeps one of k+1 pieces unchanged, so the pieces are exact seeds; around each seed the regex
library's bounded-error matching verifies the whole notice and gives its span and edits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tonguemill.llm.common import table

#: Bytes that are no part of a word (after A-Z are lower-cased) become blanks.
_BLANKED = bytes(32 if i <= 0x2F or 0x3A <= i <= 0x60 or 0x7B <= i <= 0x7F else i for i in range(256))


@dataclass(frozen=True)
class Notice:
    """Words of a notice in normal form (lower case, single blanks), its label and the most edits that still count as it."""

    text: str
    label: str
    edits: int = 0
    base: bool = False

    @cached_property
    def seeds(self) -> list[tuple[bytes, int]]:
        """k+1 pieces with their offsets; k edits leave one whole."""
        raw, n = self.text.encode(), self.edits + 1
        cuts = [len(raw) * i // n for i in range(n + 1)]
        return [(raw[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]

    @cached_property
    def pattern(self):
        # between word ends; a match is tightened to its best fit
        return regex.compile(rb"(?e)(?<![^ ])(?:%s){e<=%d}(?![^ ])" % (re.escape(self.text.encode()), self.edits))


# The contract's phrases and labels.
BASE_NOTICES = (
    Notice("gnu general public license", "gpl", 0, True),
    Notice("apache license", "apache", 0, True),
    Notice("cc by", "cc-by", 0, True),
    Notice("mit license", "mit", 0, True),
)
#: The method's notices; edits are about one in eight characters.
METHOD_NOTICES = (
    Notice("gnu general public license", "gpl", 3),
    Notice("licensed under the apache license version", "apache", 5),
    Notice("released under the mit license", "mit", 4),
    Notice("permission is hereby granted free of charge to any person obtaining a copy", "mit", 8),
    Notice("creative commons attribution", "cc-by", 3),
    Notice("licensed under cc by", "cc-by", 2),
    Notice("redistribution and use in source and binary forms", "bsd", 6),
    Notice("neither the name of the copyright holder nor the names of its contributors may be used", "bsd", 8),
    Notice("this program is free software you can redistribute it and or modify it", "gpl", 7),
    Notice("gnu lesser general public license", "lgpl", 2),
    Notice("gnu affero general public license", "agpl", 2),
    Notice("permission to use copy modify and or distribute this software for any purpose with or without fee", "isc", 8),
    Notice("this is free and unencumbered software released into the public domain", "unlicense", 7),
    Notice("spdx license identifier mit", "mit", 2),
    Notice("spdx license identifier apache 2 0", "apache", 2),
    Notice("mozilla public license", "mpl", 2),
    Notice("all rights reserved", "all-rights-reserved", 1),
)


def normal_form(text: str | None) -> bytes:
    """The words of a text joined by single blanks, as UTF-8."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().translate(_BLANKED).split())


def find_notices(norm: bytes, notices: tuple[Notice, ...]) -> list[tuple[Notice, int, int, int]]:
    """(notice, start, end, edits) of every verified place in a text of normal form, by start.

    Seeds of one place share a window; windows that touch are searched once. Places of one notice don't overlap, but those of
    an exact notice (edits 0) are all reported.
    """
    found = []
    for notice in notices:
        n, k = len(notice.text.encode()), notice.edits
        spans: list[list[int]] = []
        for seed, offset in notice.seeds:
            at = norm.find(seed)
            while at >= 0:
                spans.append([max(0, at - offset - k - 1), at - offset + n + k + 1])
                at = norm.find(seed, at + 1)
        if not spans:
            continue
        spans.sort()
        merged = [spans[0]]
        for a, b in spans[1:]:
            if a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        for a, b in merged:
            for m in notice.pattern.finditer(norm, a, min(b, len(norm)), overlapped=not k):
                found.append((notice, m.start(), m.end(), sum(m.fuzzy_counts)))
    return sorted(found, key=lambda f: f[1])


SPANS = "array<struct<label:string,start:long,n_words:long,edits:int,base:boolean>>"
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int32()), ("base", pa.bool_())]))
FIELDS = f"n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {SPANS}"


def scan_licenses(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), notices: tuple[Notice, ...] = BASE_NOTICES + METHOD_NOTICES) -> DataFrame:
    """The kept columns with counts, labels, score and spans (label, first word, words, edits) of the notices found.

    Null and empty texts have no words, no labels and score 0; an empty table gives none. Every row is scanned by itself, repeated rows
    each, so no key can be hot; long texts are searched whole. Places of several notices at one word are all reported. Only `keep` and the
    text are read; a name of the result in `keep` is refused.
    """
    if clash := set(keep) & {f.split(" ")[0] for f in FIELDS.split(f", spans {SPANS}")[0].split(", ")} | set(keep) & {"spans"}:
        raise ValueError(f"keep holds names of the result: {sorted(clash)}")
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
            for text in batch.column(batch.num_columns - 1).to_pylist():
                norm = normal_form(text)
                hits = find_notices(norm, notices)
                spans, last, word = [], 0, 0
                for notice, start, end, edits in hits:
                    word += norm.count(b" ", last, start)
                    last = start
                    spans.append({"label": notice.label, "start": word, "n_words": norm.count(b" ", start, end) + 1, "edits": edits, "base": notice.base})
                base = [s["start"] for s in spans if s["base"]]
                cols["n_words"].append(norm.count(b" ") + 1 if norm else 0)
                cols["n_base"].append(len(base))
                cols["first_word"].append(min(base, default=None))
                cols["last_word"].append(max(base, default=None))
                cols["base_labels"].append(",".join(sorted({s["label"] for s in spans if s["base"]})))
                cols["labels"].append(",".join(sorted({s["label"] for s in spans})))
                cols["score"].append(max((1 - h[3] / len(h[0].text) for h in hits), default=0.0))
                cols["spans"].append(spans)
            kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": _SPANS}
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(cols[k], kinds[k]) for k in kinds], names=[*keep, *kinds])

    return docs.select(*keep, text_col).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")
