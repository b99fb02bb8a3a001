import json
import random
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

from tonguemill.core.config import JobConfig
from tonguemill.operators import delimited, html, plain, translation, translators
from tonguemill.operators.translation import KEY


def segments(spark, docs):
    return spark.createDataFrame([(d, "", i, t) for d, ts in docs.items() for i, t in enumerate(ts)], "doc_id long, part string, seg_idx int, text string")


def greedy(texts):
    out, n, chars, batch = [], 0, 0, -1
    for t in texts:
        extra = len(t) + 8
        if n == 0 or chars + extra > 7000 or n >= 28:
            batch, n, chars = batch + 1, 0, 0
        n, chars = n + 1, chars + extra
        out.append(batch)
    return out


def test_batches(spark):
    docs = {1: ["a"] * 28, 2: ["a"] * 29, 3: ["x" * 8000, "b", "c" * 6970, "d" * 10], 4: ["e" * 3492] * 5, 5: ["f"] * 2000}
    got = translation.assign_batches(segments(spark, docs)).orderBy("doc_id", "seg_idx").collect()
    for d, ts in docs.items():
        assert [r.batch_id for r in got if r.doc_id == d] == greedy(ts)


def test_batches_across_stretches(spark):
    rng = random.Random(4)
    docs = {d: ["x" * rng.choice([1, 1, 5, 200, 900, 3000, 6993, 9000]) for _ in range(n)] for d, n in enumerate([1, 9, 10, 11, 37, 100, 333, 640, 0])}
    docs[50] = ["x"] * 500
    rows = segments(spark, docs)
    # gaps in the indexes, as blank segments leave them: whole stretches may be missing, or hold a single one
    gone = rows.where("NOT (doc_id >= 6 AND seg_idx BETWEEN 95 AND 148) AND NOT (doc_id = 7 AND seg_idx BETWEEN 151 AND 177)")
    left = {d: [(i, t) for i, t in enumerate(ts) if not (d >= 6 and 95 <= i <= 148 or d == 7 and 151 <= i <= 177)] for d, ts in docs.items()}
    for stretch in (10, 29, 4096):
        got = translation.assign_batches(gone, stretch=stretch).collect()
        own = {d: [] for d in docs}
        for r in sorted(got, key=lambda r: r.seg_idx):
            own[r.doc_id].append((r.seg_idx, r.batch_id))
        for d, ts in left.items():
            assert own[d] == list(zip([i for i, _ in ts], greedy([t for _, t in ts]))), (stretch, d)


def test_many_batches_of_one_list(spark):
    lens = [7000] * 1500 + [8] * 60
    df = spark.createDataFrame([(lens,), ([],)], "lens array<int>")
    got = [r.starts for r in df.select(translation.batch_starts(F.col("lens")).alias("starts")).collect()]
    assert got == [[*range(1500), 1500, 1528, 1556], []]


def test_saved_batches_meet_texts_in_a_merge(spark, tmp_path):
    """Saved ids are small as files and large in memory; they must not be broadcast for their files' size."""

    def save(df, label):
        df.write.parquet(f"{tmp_path}/{label}")
        return spark.read.schema(df.schema).parquet(f"{tmp_path}/{label}")

    docs = {1: ["a"] * 30, 2: ["c"], 9: ["d", "e"]}
    work = save(segments(spark, docs), "segments")
    batches = translation.gather_batches(work, save(translation.assign_batches(work), "assigned"))
    got = {(r.doc_id, r.batch_id): [(i.seg_idx, i.text) for i in r["items"]] for r in batches.collect()}
    assert got == {(1, 0): [(i, "a") for i in range(28)], (1, 1): [(28, "a"), (29, "a")], (2, 0): [(0, "c")], (9, 0): [(0, "d"), (1, "e")]}
    plan = batches._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_round_trip_plain(spark):
    texts = ["a\n\nb", "\n\na\n\n\n\nb\n", "", "\n", "a", "x\n\n   \n\ny\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    segs = plain.paragraph_segments(df)
    done, _ = translation.translate_segments(segs, lambda b, c: b.select(*KEY, "batch_id", F.transform("items", lambda i: i["text"]).alias("translations"), F.lit(None).cast("string").alias("error")))
    assert [r.text for r in plain.assemble_text(done).orderBy("doc_id").collect()] == texts


def test_round_trip_html_and_csv(spark):
    pages = spark.createDataFrame([(0, "<p>abc<b>de</b> f>g hij</p>x"), (1, "<i>12345</i>"), (2, "no tags\n\nhere")], "doc_id long, html string")
    segs = html.html_segments(pages)
    assert sorted((r.doc_id, r.kind, r.text) for r in segs.collect()) == [(0, "slot", " f>g hij"), (0, "slot", "abc"), (1, "paragraph", "<i>12345</i>"), (2, "paragraph", "here"), (2, "paragraph", "no tags")]
    back = html.assemble_html(pages, segs.where("kind = 'slot'"))
    assert {r.doc_id: r.html for r in back.collect()} == {r.doc_id: r.html for r in pages.collect()}
    docs = spark.createDataFrame([(0, 'a,"b,""c""",1\nd,e,2\n'), (1, "﻿1,2\r\n3,4"), (2, 'x,"open,y\nz,w')], "doc_id long, text string")
    cells = delimited.csv_cell_segments(docs)
    assert [(r.doc_id, r.text) for r in cells.orderBy("doc_id", "seg_idx").collect()] == [(0, "a"), (0, 'b,"c"'), (0, "d"), (0, "e"), (2, "x"), (2, "open,y"), (2, "z"), (2, "w")]
    out = {r.doc_id: r.text for r in delimited.assemble_csv(docs, cells).collect()}
    assert out[0] == 'a,"b,""c""",1\nd,e,2\n' and out[1] == "﻿1,2\r\n3,4" and out[2] == 'x,"open,y"\nz,w\n'


def test_rtf(spark):
    rows = ["{\\rtf1{\\fonttbl{\\f0 Arial;}}\\f0 Hei \\'e5 du\\par\r\n\r\n\r\nnei}", "{\\rtf1 flat}", None]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    assert [r[0] for r in df.select(plain.strip_rtf(F.col("t"))).collect()] == ["Hei  du\n\nnei", "", ""]


def test_answers(spark):
    ok = json.dumps(["a", None, 3])
    rows = [
        (200, json.dumps({"output_text": f"```json\n{ok}\n```"}), ["a", "", "3"], None),
        (200, json.dumps({"output": [{"text": "["}, {"content": ['"a",', {"text": '"b","c"]'}]}]}), ["a", "b", "c"], None),
        (200, json.dumps({"output_text": "[1]"}), None, "Forventet 3 oversettelser, fikk 1."),
        (200, json.dumps({"output_text": "nei"}), None, "Kunne ikke lese oversettelsen som JSON."),
        (200, json.dumps({"output_text": " "}), None, "Tomt svar."),
        (500, json.dumps({"error": "full"}), None, "full"),
        (500, json.dumps({"error": {"message": "deep"}}), None, "deep"),
        (503, json.dumps({"message": "flat"}), None, "flat"),
        (503, "{}", None, "API-feil 503"),
        (502, "<html>" + "x" * 300, None, ("<html>" + "x" * 300)[:240]),
    ]
    df = spark.createDataFrame([(i, s, b, 3) for i, (s, b, _, _) in enumerate(rows)], "i int, http_status int, body string, expected int")
    got = translation.read_responses(df).orderBy("i").collect()
    assert [(r.translations, r.error) for r in got] == [r[2:] for r in rows]


def test_proxy_gives_no_part_of_a_bad_answer(spark):
    df = spark.createDataFrame([("<html>x", 502), ('{"error":"e"}', 500), ("{}", 401)], "body string, status int")
    got = df.select(translation.response_error(F.col("body"), F.col("status"), proxy=True, vendor="V").alias("e")).collect()
    assert [r.e for r in got] == ["Ugyldig svar fra V (502)", "e", "Logg inn på nytt."]


def test_rows_are_translated_as_segments_are(spark, tmp_path):
    """In place and through rows of batches: retried, failed, blank, null and long texts."""
    n = iter(range(99))

    def save(df, label):
        at = f"{tmp_path}/{label}{next(n)}"
        df.write.parquet(at)
        return spark.read.parquet(at)

    texts = {1: ["a", None, " ", "b"], 2: ["c"], 3: [], 4: ["d"] * 70 + ["e" * 8000], 9: ["d", "f"]}
    rows = spark.createDataFrame([(d, "", ts, "x") for d, ts in texts.items()], "doc_id long, part string, texts array<string>, n_batch string")
    told = {r.doc_id: r for r in translation.translate_rows(rows, translators.model(fake({2}), save), JobConfig("", "")).collect()}
    assert {d: r.texts for d, r in told.items()} == {1: ["A", "", " ", "B"], 2: ["C"], 3: [], 4: ["D"] * 70 + ["E" * 8000], 9: ["d", "f"]}
    assert [(told[d].n_batches, told[d].n_texts) for d in texts] == [(1, 2), (1, 1), (0, 0), (4, 71), (1, 2)]
    status = {r.doc_id: (r.n_batches, r.ok) for r in translation.row_status(translation.translate_rows(rows, translators.model(fake({2}), save))).collect()}
    assert status == {1: (1, True), 2: (1, True), 4: (4, True), 9: (1, False)}
    here = translation.translate_rows(rows, translators.pseudo)
    assert {r.doc_id: r.texts for r in here.collect()}[1] == ["e", "", " ", "b"]
    assert "Exchange" not in here._jdf.queryExecution().executedPlan().toString()


def fake(bad_first):
    """Answers in the model's form; batches of the documents in bad_first fail when asked first."""

    def run(parts):
        for rows in parts:
            bodies = []
            for doc, prompt in zip(rows.doc_id, rows.prompt):
                again = prompt.endswith("Ingen annen tekst.")
                items = json.loads(prompt[prompt.index("\n\n[") : prompt.rindex("]") + 1])
                bad = doc in bad_first and not again or doc == 9
                bodies.append(json.dumps({"output_text": "nei"} if bad else {"output_text": json.dumps([x.upper() for x in items])}))
            yield rows.drop(columns="prompt").assign(http_status=200, body=bodies)

    return run


def test_retry_and_document_status(spark, tmp_path):
    def save(df, label):
        df.write.parquet(f"{tmp_path}/{label}")
        return spark.read.parquet(f"{tmp_path}/{label}")

    segs = segments(spark, {1: ["a", " ", "b"], 2: ["c"], 9: ["d"]})
    done, answers = translation.translate_segments(segs, translators.model(fake({2}), save), JobConfig("", ""))
    assert [(r.doc_id, r.text) for r in done.orderBy("doc_id", "seg_idx").collect()] == [(1, "A"), (1, " "), (1, "B"), (2, "C"), (9, "d")]
    status = {r.doc_id: (r.ok, r.error) for r in translation.document_status(answers).collect()}
    assert status == {1: (True, None), 2: (True, None), 9: (False, "Kunne ikke lese oversettelsen som JSON.")}


def test_guard_and_glossary(spark):
    df = spark.createDataFrame([("",), ("x" * 80_001,), ("ok",)], "prompt string")
    assert [r.error for r in translation.guard_prompt(df).collect()] == ["Mangler tekst å oversette.", "Tekstbiten er for stor.", None]
    terms = spark.createDataFrame([("cat", "katt"), ("dog", "hund")], "term string, translation string")
    done, _ = translation.translate_segments(segments(spark, {1: ["the cat,\n a dog!"]}), translators.glossary(terms))
    assert done.first().text == "the katt,\n a hund!"


def test_layout_check(spark):
    df = spark.createDataFrame([("a\nb 12 http://x.y", "c\nd 12 http://x.y"), ("a\tb 1,5", "a b")], "source string, target string")
    got = translation.layout_check(df).collect()
    assert [r.kept for r in got] == [True, False] and got[1].d_tabs == -1 and got[1].lost == ["1,5"]


def test_layout_losses(spark):
    rng = random.Random(6)
    words = ["1", "22", "a@b.cd", "http://x.y/z", "ord", "1,5"]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 12))), " ".join(rng.choices(words, k=rng.randint(0, 12)))) for _ in range(80)] + [(None, None), ("7 7 7", "7"), ("1 2", "2 1"), ("1 2", "1 x 2")]
    got = translation.layout_losses(spark.createDataFrame(rows, "source string, target string").coalesce(1)).collect()
    for (a, b), r in zip(rows, got, strict=True):
        a, b = ([w for w in (x or "").split() if w not in ("ord", "x")] for x in (a, b))
        assert [tuple(x) for x in r.lost] == sorted((Counter(a) - Counter(b)).items()) and [tuple(x) for x in r.added] == sorted((Counter(b) - Counter(a)).items())
        assert r.in_order == (a == b)


def test_http_without_network():
    call = translators.http_calls("http://127.0.0.1:9/none", "m", "NO_SUCH_KEY", timeout=1)
    (out,) = list(call(iter([pd.DataFrame({"doc_id": [1], "part": [""], "batch_id": [0], "expected": [1], "prompt": ["x"]})])))
    assert out.http_status[0] == 0 and "error" in out.body[0]


def test_overall_progress_in_ranges(spark):
    from tonguemill.operators import report

    names = [None, "", "é", "Z", *[f"n{i * 7919 % 1000}" for i in range(1000)]]
    files = spark.createDataFrame([(x, 1, 2) for x in names], "name string, done int, total int").repartition(5)
    df = report.overall_progress(files)
    assert "SinglePartition" not in df._jdf.queryExecution().toString()
    got = {r.name: (r.i, r.percent) for r in df.collect()}
    want = sorted(names, key=lambda x: (x is not None, (x or "").encode()))
    assert got == {x: (i, int((i + 0.5) / len(names) * 100 + 0.5)) for i, x in enumerate(want)}
    assert report.overall_progress(files.where("total = 0")).count() == 0


def test_translate_documents_keeps_blank_ones(spark, data, tmp_path):
    from tonguemill.plans import catalogue

    docs = spark.read.parquet(f"{data}/documents.parquet")
    blank = [(10_001, None), (10_002, ""), (10_003, " \n\n ")]
    odd = spark.createDataFrame(blank, "doc_id long, text string")
    docs.limit(3).unionByName(odd, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_segments, r.n_batches, r.translated) for r in catalogue.QUERIES["translate_documents"](spark, str(tmp_path)).collect()}
    assert len(got) == 6
    assert all(got[i][:2] == (0, 0) for i, _ in blank)
    assert [got[i][2] or "" for i, _ in blank] == ["", "", " \n\n\n\n "]  # the query's fixture doubles line ends
