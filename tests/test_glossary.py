"""Glossary terms of several words, in place and by a join, against a plain search."""

import random
import re

from pyspark.sql import functions as F

from tonguemill.core.config import JobConfig
from tonguemill.operators import glossary, translation
from tests.test_translation import segments


def plain(text, terms):
    """Longest term first at every word."""
    out, i = "", 0
    for_all = sorted(terms, key=lambda t: -len(t.split()))
    while i < len(text):
        begins = re.match(r"[^\W_]", text[i]) and not (i and re.match(r"[^\W_]", text[i - 1]))
        for t in for_all if begins else ():
            if m := re.compile(r"[ \t]+".join(map(re.escape, t.split())) + r"(?![^\W_])").match(text, i):
                out, i = out + terms[t], m.end()
                break
        else:
            out, i = out + text[i], i + 1
    return out


def test_both_ways_match_a_plain_search(spark):
    rng = random.Random(3)
    words = ["a", "b", "c", "ab", "é", "ø1", "½"]
    terms = {" ".join(rng.choices(words, k=rng.randint(1, 4))): f"<{i}>" for i in range(25)}
    texts = ["".join(rng.choice(words) + rng.choice([" ", "  ", "\t", ", ", "\n", "_", "-"]) for _ in range(rng.randint(0, 25))) for _ in range(120)]
    table = [(t.replace(" ", " \t "), x) for t, x in terms.items()] + [(t, "~later") for t in terms] + [("a", None), ("a-b", "no"), ("", "no"), (None, "no")]
    terms_df = spark.createDataFrame(table, "term string, translation string")
    segs = segments(spark, {1: texts[:60], 2: texts[60:]})
    for limit in (1 << 20, 0):
        done, _ = translation.translate_segments(segs, glossary.glossary(terms_df, broadcast=limit), JobConfig("", ""))
        got = {(r.doc_id, r.seg_idx): r.text for r in done.collect()}
        assert got == {(1 + i // 60, i % 60): plain(t, terms) for i, t in enumerate(texts)}, limit


def test_no_terms(spark):
    none = spark.createDataFrame([], "term string, translation string")
    done, answers = translation.translate_segments(segments(spark, {1: ["a b"]}), glossary.glossary(none))
    assert done.first().text == "a b" and answers.where(F.col("error").isNotNull()).count() == 0
