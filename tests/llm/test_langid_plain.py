"""Language ID against a plain-Python version of its fit and its decoding; odd rows of it and of the quality ledger."""

import math
import zlib
from collections import Counter

import pytest

from tonguemill.llm import langid, quality, registry

BUCKETS = 1 << 16


def trigrams(text):
    b = [x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32 for x in (text or "").encode()]
    return Counter((((x * 0x3D4D51CB + y * 0x2C1B3C6D + z * 0x297A2D39) % 2**32) * 0x9E3779B1 % 2**32) >> 16 for x, y, z in zip(b, b[1:], b[2:]))


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def plain_fit(rows):
    """(langs, code, weights by bucket, trust) of rows (doc_id, text, lang)."""
    counts = {}
    for doc_id, text, lang in rows:
        if lang is not None and text is not None and not held_out(doc_id):
            counts.setdefault(lang, Counter()).update(trigrams(text))
    langs = sorted(counts)
    size = 4
    while size < 2 * len(langs):
        size *= 2
    code = [[(-1) ** bin(i & j).count("1") for j in range(1, size)] for i in range(1, len(langs) + 1)]
    use = [j for j in range(size - 1) if abs(sum(row[j] for row in code)) < len(langs)]
    code = [[row[j] for j in use] for row in code]
    total = [sum(counts[x].values()) + 0.5 * BUCKETS for x in langs]
    p = lambda i, b: (counts[langs[i]][b] + 0.5) / total[i]
    bits, n = range(len(use)), range(len(langs))
    weights = []
    for b in range(BUCKETS):
        own = [p(i, b) for i in n]
        side = lambda k, s: [own[i] for i in n if code[i][k] == s]
        weights.append([math.log(sum(side(k, 1)) / len(side(k, 1)) / (sum(side(k, -1)) / len(side(k, -1)))) for k in bits])
    expected = [[code[i][k] * sum(p(i, b) * weights[b][k] for b in range(BUCKETS)) for k in bits] for i in n]
    scale = [sum(abs(expected[i][k]) for i in n) / len(langs) for k in bits]
    trust = [max(min(expected[i][k] for i in n), 0) / scale[k] + 0.1 for k in bits]
    return langs, code, [[w / s for w, s in zip(ws, scale, strict=True)] for ws in weights], [3 * t / sum(trust) for t in trust]


def plain_identify(model, text):
    """(language, probability, gap to the second)."""
    langs, code, weights, trust = model
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0, 0.0
    own = trigrams(text)
    n = sum(own.values())
    margin = [sum(m * weights[b][k] for b, m in own.items()) / n if n else 0.0 for k in range(len(trust))]
    loss = [sum(t * math.log1p(math.exp(-4 * c * m)) for t, c, m in zip(trust, row, margin, strict=True)) for row in code]
    odds = [math.exp(min(loss) - x) for x in loss]
    best = sorted(((x / sum(odds), -i) for i, x in enumerate(odds)), reverse=True)
    return langs[-best[0][1]], best[0][0], best[0][0] - best[1][0]


def test_query_matches_plain_python(spark, data):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    model = plain_fit(rows)
    got = {r.doc_id: r for r in registry.QUERIES["op4_language_id"](spark, data).collect()}
    assert len(got) == len(rows)
    for doc_id, text, _ in rows:
        lang, score, gap = plain_identify(model, text)
        r = got[doc_id]
        assert r.held_out == held_out(doc_id) and r.score == pytest.approx(score, abs=1e-4) and (r.lang_pred == lang or gap < 1e-4)


def test_identify_odd_rows(spark):
    kind = "doc_id long, text string, lang string, score string"
    rows = [(1, "the cat and the dog", "en", "x"), (1, "the cat and the dog", "en", "x"), (2, "le chat et le chien", "fr", "x"), (3, None, "fr", "x"), (4, "12 !", None, "x"), (None, "é", "fr", "x"), (6, "the cat " * 30_000, None, "x"), (7, "le chat et la souris", "fr", "x"), (8, "the mouse", "en", "x")]
    docs = spark.createDataFrame(rows, kind)
    got = [(r.doc_id, r.lang_pred) for r in langid.identify(docs, langid.fit(docs)).collect()]
    assert sorted((i or 0, x) for i, x in got if x != "und")[-1][0] == 8 and got.count((1, "en")) == 2 and (6, "en") in got and {(3, "und"), (4, "und")} <= set(got)
    none = docs.where("doc_id = 99")
    assert langid.identify(none, langid.fit(none)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(none)).collect()} == {"und"}


def test_ledger_of_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b " * 40, 5)] * 2 + [(2, None, 5)], "doc_id long, text string, n_words int")
    got = quality.apply_policy(quality.ledger(docs)).collect()
    assert sorted((r.doc_id, r.n_words, r.base_failed, r.kept) for r in got) == [(1, 80, True, False), (1, 80, True, False), (2, 0, True, False)]
    assert quality.ledger(docs.limit(0)).count() == 0 and quality.ablations(quality.ledger(docs.limit(0))).count() == 0
