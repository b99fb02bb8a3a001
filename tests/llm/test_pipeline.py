"""The pipeline against a brute-force version of its stages."""

import itertools
import re

import duckdb
import numpy as np
import public_tokenizers

import corpus_pipeline
from tests.llm.test_joins import roots
from tonguemill.llm import packing, registry, substrings


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    extra = spark.createDataFrame([(10_001, "12 34 ... 56", None, "s", 12), (10_002, None, None, "s", None)], docs.schema)
    docs, sizes = docs.union(extra), []
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, data)
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]
        docs = spark.createDataFrame(rows, docs.schema)
        sizes.append({r[0]: r[1] for r in rows})
    lang, quality, near, cut = sizes
    assert len(lang) == 200 and 10_001 not in lang
    assert all(len(t.split()) >= 50 for t in quality.values())
    ids = sorted(quality)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in ([x for x in re.findall(r"[^\x20\x09-\x0D]+", quality[i].lower())] for i in ids)]
    links = [(i, j) for i in range(len(ids)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert sorted(near) == [ids[i] for i, r in enumerate(roots(len(ids), links)) if r == i]
    assert sorted(cut) == sorted(near)
    windows = {}
    for i, t in near.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        for k in range(len(w) - 34):
            windows.setdefault(tuple(w[k : k + 35]), []).append((i, k))
    for i, t in near.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        gone = {k + j for at in windows.values() if len(at) > 1 for d, k in at if d == i for j in range(35)}
        assert re.findall(r"[^\x20\x09-\x0D]+", cut[i]) == [x for k, x in enumerate(w) if k not in gone]
    packed = corpus_pipeline.STAGES[4][1](spark, docs, data)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(cut)


def test_run(spark, data):
    assert corpus_pipeline.run(spark, data).count() > 0


def test_near_duplicates_tells_rows_of_one_id_apart(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(7, a), (7, b), (3, b), (7, c), (7, c), (None, d), (None, d), (None, a), (9, " "), (9, " "), (None, None)]
    rows = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], docs.schema)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, rows, data).collect()]
    assert sorted(got, key=repr) == sorted([(7, a), (3, b), (7, c), (None, d), (9, " "), (9, " "), (None, None)], key=repr)


def test_language_keeps_all_with_letters(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    texts = ["a", "ab", "the cat und der Hund", "q q q", "1 2", None, "", "é"]
    odd = spark.createDataFrame([(20_000 + i, t, None, "s", 1) for i, t in enumerate(texts)], docs.schema)
    want = {20_000, 20_001, 20_002, 20_003, 20_007}
    told = corpus_pipeline.languages(docs.union(odd)).where("doc_id >= 20000").collect()
    assert any(r.ambiguous and r.kept for r in told)
    assert {r.doc_id for r in corpus_pipeline.language(spark, docs.union(odd), data).where("doc_id >= 20000").collect()} == want
    assert {r.doc_id for r in corpus_pipeline.language(spark, odd, data).collect()} == want  # no label to learn from


def test_run_matches_brute_force(spark, data, tmp_path, monkeypatch):
    """Rows of run(), and what each of its stages kept and rejected, against a version without Spark's operators."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    long = " ".join(f"p{i}" for i in range(80))
    odd = [(20_000, "12 34 ... 56"), (20_001, None), (20_002, "too short"), (20_003, "a b c " * 40), (20_004, long), (20_005, long), (20_006, "## $$ " * 60 + "x")]
    odd.append((20_007, " ".join(f"q{i}" for i in range(90)) + " " + " ".join(f"p{i}" for i in range(40))))
    odd.append((20_008, " ".join(f"r{i} " for i in range(1500))))
    docs.union(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in odd], docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    kept, save = {}, corpus_pipeline.Scratch.save

    def noted(self, df, label):
        out = save(self, df, label)
        if "/pipeline-" in self.root:
            kept[label] = {(r.doc_id, r.text) for r in out.collect()} if "text" in out.columns else None
        return out

    monkeypatch.setattr(corpus_pipeline.Scratch, "save", noted)
    got = sorted((r.doc_id, r.piece, r.start, r.length) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert list(kept) == [name for name, _ in corpus_pipeline.STAGES]

    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    lang = {i: t for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    good = {i for i, ok in con.sql(f"select doc_id, kept from ({registry.SQL['op6_quality_rules']})").fetchall() if ok}
    quality = {i: t for i, t in lang.items() if i in good}
    ids = sorted(quality)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (split(quality[i].lower()) for i in ids)]
    links = [(i, j) for i in range(len(ids)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    near = {ids[i]: quality[ids[i]] for i, r in enumerate(roots(len(ids), links)) if r == i}
    at = {}
    for i, t in near.items():
        w = split(t)
        for k in range(len(w) - 34):
            at.setdefault(tuple(w[k : k + 35]), []).append((i, k))
    gone = {i: np.zeros(len(split(t)), bool) for i, t in near.items()}
    for i, k in itertools.chain.from_iterable(x for x in at.values() if len(x) > 1):
        gone[i][k : k + 35] = True
    cut = {i: substrings.cut_text(t, gone[i]) for i, t in near.items()}
    for name, want, before in zip(list(kept), (lang, quality, near, cut), (texts, lang, quality, near), strict=False):
        assert kept[name] == set(want.items())
        assert before.keys() - {i for i, _ in kept[name]} == before.keys() - want.keys()
    assert texts.keys() - lang.keys() == {20_000, 20_001} and {20_002, 20_003, 20_006} <= lang.keys() - quality.keys() and 20_005 in quality.keys() - near.keys() and gone[20_007].any()
    tok, want = packing.TextIds(public_tokenizers.path("byte_bpe_50k.json")), []
    for i, t in cut.items():
        lengths = packing.cut_lengths(len(tok.encode([t])[0]) // 4 + 1)
        want += [(i, k, sum(lengths[:k]), n) for k, n in enumerate(lengths)]
    assert got == sorted(want)


def test_stages_on_empty_and_repeated_rows(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    empty = docs.where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, data).count() == 0
    text = " ".join(f"w{i} the" for i in range(60))
    rows = spark.createDataFrame([(5, text, "en", "s", 1)] * 3 + [(None, text, "en", "s", 1), (6, None, None, None, None)], docs.schema)
    counts = [stage(spark, rows, data).count() for _, stage in corpus_pipeline.STAGES]
    assert counts == [4, 4, 2, 5, 5]  # of equal texts one stays beside the null
