"""Source divergence: skybands, exact weights and odd rows; the query itself is held against SQL in test_sql.py."""

import random
from collections import Counter

import numpy as np

from tonguemill.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, value long, rank string"


def brute(rows, top=10, least=10):
    """audit_sources over (text, lang, source), one row at a time."""
    docs = [(lang or "", source or "", [w.decode() for part in divergence.terms((text or "").encode()) for w in part]) for text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= least}
        count = {s: Counter(t for d in own if d[1] == s for t in d[2] if t in kept) for s in {d[1] for d in own}}
        every = sum(count.values(), Counter())
        p = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s, c in count.items():
            pairs = sorted((-sum(f(p(c, t), p(o, t)) for t in kept), x.encode()) for x, o in count.items() if x != s)
            told = sorted((-f(p(c, t), p(every, t)), t.encode()) for t in kept if c[t] and p(c, t) > p(every, t))[:top]
            out |= {(lang, s, part, t.decode(), -v, k + 1) for part, rows in (("pair", pairs), ("term", told)) for k, (v, t) in enumerate(rows)}
    return out


def got(spark, rows, **kw):
    df = spark.createDataFrame([(i, *r, 0, "x") for i, r in enumerate(rows)], SCHEMA)
    told = divergence.audit_sources(df, **kw)
    assert told.columns == ["lang", "source", "part", "item", "value", "rank"]
    out = [tuple(r) for r in told.collect()]
    assert len(out) == len(set(out))
    return set(out)


def test_divergence_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{chr(97 + i)}" for i in range(26)] + ["É", "é", "中文", "ß", "x" * 300]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 60))), rng.choice(["a", "b", None]), rng.choice(["s", "t", "u", "", None])) for _ in range(300)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows, top=3, least_docs=1) == brute(rows, 3, 1)


def test_divergence_many_sources_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 3)
    monkeypatch.setattr(divergence, "CHUNK", 4)
    rng = random.Random(6)
    rows = [(" ".join(rng.choices("abcdefghijk", k=30)), "x", f"s{rng.randint(0, 16)}") for _ in range(120)]
    assert got(spark, rows, least_docs=2) == brute(rows, least=2)


def test_divergence_odd_rows(spark):
    assert got(spark, []) == set()
    # no kept term: pairs of value 0, also with a group without terms
    assert got(spark, [(None, None, None), ("12 34", None, "s")]) == {("", "", "pair", "s", 0, 1), ("", "s", "pair", "", 0, 1)}
    # repeated rows count each; a hot source, a long text; ties go by UTF-8
    rows = [("A b\0BÉ", "l", "hot")] * 40 + [("b c " * 40_000, "l", "t")] * 10 + [("é", "l", "u")]
    assert got(spark, rows) == brute(rows)
    # a group without others has no pairs
    assert {r[2] for r in got(spark, [("a b", "l", "s")] * 10)} <= {"term"}


def test_long_text_is_split_between_words(monkeypatch):
    monkeypatch.setattr(divergence, "STRETCH", 7)
    raw = ("abc de " * 9 + "x" * 30 + " y").encode()
    assert [w for part in divergence.terms(raw) for w in part] == raw.split()


def test_skyband_is_exact():
    rng = np.random.default_rng(1)
    for k in (1, 3, 10):
        n, total, rank = rng.integers(0, 30, 1500), rng.integers(0, 30, 1500), rng.permutation(1500)
        over = ((n[:, None] >= n) & (total[:, None] <= total) & (rank[:, None] < rank)).sum(0)
        assert sorted(divergence.skyband(n, total, rank, k)) == np.flatnonzero(over < k).tolist()


def test_weights_are_exact():
    big = 8 * 10**15
    for c, size in ((0, 2), (7, 13), (big - 5, big), (big // 3, big)):
        assert divergence.weights(np.array([c]), np.array([size]))[0] == 1 + 10**9 * (c + 2) // size
