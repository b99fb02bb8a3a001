"""Queries of what outlives a task or a job (the request ledger, the document sink, exactly-once ingest), of glossaries and of losses."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tonguemill.core.shared import hadoop_path, own_folder
from tonguemill.operators import ledger, plain, progress, translation, translators
from tonguemill.plans import fixtures as fx
from tonguemill.plans.catalogue import _TOKENS, SQL, TURN, query
from tonguemill.sources import files, sink
from tonguemill.streaming import ingest


def _model(prompt: str) -> tuple[int, str]:
    """Stands in for a model's endpoint: translates as the pseudo translator does; some prompts fail, some of those again when retried."""
    plain = prompt.removesuffix(translation.RETRY)
    if len(plain) % 3 == 0 and (plain == prompt or len(plain) % 4 == 0):
        return 500, json.dumps({"error": f"full {len(plain) % 10}"})
    texts = json.loads(plain[plain.index("\n\n[") :])
    turned = [t.translate(str.maketrans(translators.VOWELS, translators.TURNED)) for t in texts]
    return 200, json.dumps({"output": [{"content": [{"text": json.dumps(turned, ensure_ascii=False)}]}]}, ensure_ascii=False)


@query(f"""WITH p AS ({SQL["build_prompts"].replace("norsk nynorsk", "norsk bokmål")}), n AS (SELECT *, length(prompt) AS n FROM p),
s AS (SELECT doc_id, batch_id, prompt, n, CAST(from_json(substr(prompt, instr(prompt, chr(10) || chr(10) || '[')), '["VARCHAR"]') AS VARCHAR[]) AS texts, n % 12 = 0 AS failed FROM n),
asked AS (SELECT count(DISTINCT prompt) + count(DISTINCT prompt) FILTER (n % 3 = 0) AS n_asked FROM n)
SELECT doc_id, batch_id, CASE WHEN NOT failed THEN list_transform(texts, lambda t: {TURN.format("t")}) END AS translations, CASE WHEN failed THEN 'full ' || n % 10 END AS error, n_asked FROM s, asked""")
def request_ledger(spark, sf_dir):
    """Every batch asked through a ledger; then the job starts again with the same ledger, and asks nothing."""
    work, _ = translation.split_blank(fx.turn_segments(spark, sf_dir))
    batches = translation.gather_batches(work, translation.assign_batches(work))
    folder, config = own_folder(spark, "ledger"), translation.JobConfig("", "")
    ledger.asked_once(ledger.RequestLedger(spark, folder), _model)(batches, config)
    again = ledger.RequestLedger(spark, folder)
    answers = ledger.asked_once(again, lambda prompt: (500, "asked twice"))(batches, config)
    asked = again.records().agg(F.count("*").alias("n_asked"))
    return answers.drop("part").withColumn("one", F.lit(1)).join(asked.withColumn("one", F.lit(1)), "one").drop("one")


_TEXT = "CASE WHEN doc_id % 50 = 0 THEN '' ELSE " + TURN.format("text") + " END"
_NAME = "source || '/' || CASE WHEN doc_id % 5 = 0 THEN '_' ELSE '' END || doc_id || '.txt'"


@query(f"SELECT {_NAME} AS name, CAST(octet_length(encode({_TEXT})) AS BIGINT) AS bytes, {_TEXT} AS text FROM documents")
def document_sink(spark, sf_dir):
    """Every document's translation as a file, written by the sink and read again; some names begin with _, some files are empty."""
    out = own_folder(spark, "sink")
    docs = fx.table(spark, sf_dir, "documents").selectExpr(f"concat('{out}/', {_NAME}) AS dest", f"cast({_TEXT} AS binary) AS content")
    written = sink.write_documents(docs, out)
    found = files.decode_text(files.scan_documents(spark, out)).select(F.concat(F.lit(out + "/"), "name").alias("dest"), "name", "text")
    # the texts are read in tasks, so Spark measures only their paths; unhinted it would send all texts through the driver
    return found.join(written.hint("merge"), "dest").select("name", "bytes", "text")


@query(f"SELECT {_NAME} AS name, CAST(doc_id % 3 + 1 AS INTEGER) AS entry, {_TEXT.replace(TURN.format('text'), TURN.format(TURN.format('text')))} AS text FROM documents")
def stream_ingest(spark, sf_dir):
    """Every document as a file of a growing folder, in three waves, translated into a table; then the last batch is replayed."""
    folder = own_folder(spark, "ingest")
    table, checkpoint = f"{folder}/table", f"{folder}/checkpoint"

    def translate(batch):
        rows = files.decode_text(batch).select("name", "entry", "text")
        told = translation.translate_rows(plain.paragraph_rows(rows, id_col="name", keep=("entry",)), translators.pseudo)
        return told.select(F.col("doc_id").alias("name"), "entry", plain.join_paragraphs().alias("text"))

    for wave in range(3):
        docs = fx.table(spark, sf_dir, "documents").where(F.col("doc_id") % 3 == wave)
        sink.write_documents(docs.selectExpr(f"concat('{folder}/in/', {_NAME}) AS dest", f"cast({_TEXT} AS binary) AS content"), f"{folder}/in")
        ingest.ingest_table(spark, f"{folder}/in", table, checkpoint, translate).awaitTermination()
    fs, last = hadoop_path(spark, f"{checkpoint}/commits/2")
    fs.delete(last, True)  # as if the driver had been lost before it wrote this down
    ingest.ingest_table(spark, f"{folder}/in", table, checkpoint, translate).awaitTermination()
    return spark.read.parquet(table).select("name", "entry", "text")


_TERMS = """t AS (SELECT item_id, regexp_extract_all(text, '[\\p{L}\\p{N}]+') AS ws FROM benchmark),
terms AS (SELECT term, min(translation) AS translation FROM (
  SELECT ws[1] AS term, 'en' || item_id AS translation FROM t UNION ALL SELECT ws[2] || ' ' || ws[3], 'to ' || item_id FROM t UNION ALL SELECT ws[4] || ' ' || ws[5] || ' ' || ws[6], 'tre ' || item_id FROM t
  UNION ALL SELECT ws[4] || ' ' || ws[5], 'to ' || item_id FROM t) WHERE term IS NOT NULL GROUP BY term)"""


@query(f"""WITH RECURSIVE {_TERMS}, segs AS (SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS seg_idx, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+') AS ps FROM conversations),
f AS (SELECT *, CASE WHEN len(ps) = 0 THEN NULL WHEN regexp_matches(ps[1], '^[\\p{{L}}\\p{{N}}]') THEN 1 ELSE 2 END AS k0 FROM segs),
k AS (SELECT doc_id, seg_idx, ps, unnest(range(k0, len(ps) + 1, 2)) AS k FROM f),
runs AS (SELECT doc_id, seg_idx, k, 1 AS w, ps[k] AS term FROM k
  UNION ALL SELECT doc_id, seg_idx, k, 2, ps[k] || ' ' || ps[k + 2] FROM k WHERE regexp_full_match(ps[k + 1], '[ \\t]+')
  UNION ALL SELECT doc_id, seg_idx, k, 3, ps[k] || ' ' || ps[k + 2] || ' ' || ps[k + 4] FROM k WHERE regexp_full_match(ps[k + 1], '[ \\t]+') AND regexp_full_match(ps[k + 3], '[ \\t]+')),
best AS (SELECT doc_id, seg_idx, k, max(w) AS w, arg_max(translation, w) AS translation FROM runs JOIN terms USING (term) GROUP BY ALL),
go AS (SELECT doc_id, seg_idx, k0 AS k FROM f WHERE k0 <= len(ps)
  UNION ALL SELECT go.doc_id, go.seg_idx, go.k + 2 * coalesce(w, 1) FROM go JOIN f USING (doc_id, seg_idx) LEFT JOIN best ON best.doc_id = go.doc_id AND best.seg_idx = go.seg_idx AND best.k = go.k WHERE go.k + 2 * coalesce(w, 1) <= len(ps)),
told AS (SELECT doc_id, seg_idx, string_agg(coalesce(translation, ps[k]) || coalesce(ps[k + 2 * coalesce(w, 1) - 1], ''), '' ORDER BY k) AS rest FROM go JOIN f USING (doc_id, seg_idx) LEFT JOIN best USING (doc_id, seg_idx, k) GROUP BY ALL)
SELECT doc_id, seg_idx, CASE WHEN k0 = 2 THEN ps[1] ELSE '' END || coalesce(rest, '') AS text FROM f LEFT JOIN told USING (doc_id, seg_idx)""")
def glossary_translation(spark, sf_dir):
    """Every turn by a glossary of words that the benchmark's items begin with, one, two and three at a time; some terms have several
    translations, some begin alike."""
    ws = F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    t = fx.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("item"), ws.alias("ws"))
    some = [(0, 1, "en"), (1, 2, "to "), (3, 3, "tre "), (3, 2, "to ")]
    pairs = F.array(*[F.struct(F.when(F.size("ws") >= a + n, F.array_join(F.slice("ws", a + 1, n), " ")).alias("term"), F.concat(F.lit(head), "item").alias("translation")) for a, n, head in some])
    terms = t.select(F.explode(pairs).alias("p")).select("p.term", "p.translation")
    done, _ = translation.translate_segments(fx.turn_segments(spark, sf_dir), translators.glossary(terms))
    return done.select("doc_id", "seg_idx", "text")


@query(f"""WITH p AS (SELECT doc_id, text || ' 7 7 7 1,5 a@b.cd' AS source, CASE doc_id % 4 WHEN 0 THEN text || ' 7 1,5 a@b.cd' WHEN 1 THEN 'a@b.cd 1,5 7 ' || text || ' 7 7' WHEN 2 THEN replace(text, '1', '2') || ' 7 7 7 7 1,5' ELSE text || ' 7 7 7 1,5 a@b.cd' END AS target FROM documents),
l AS (SELECT doc_id, {_TOKENS.format(x="source")} AS s, {_TOKENS.format(x="target")} AS t FROM p),
n AS (SELECT doc_id, token, sum(d) AS n FROM (SELECT doc_id, unnest(s) AS token, 1 AS d FROM l UNION ALL SELECT doc_id, unnest(t), -1 FROM l) GROUP BY ALL HAVING sum(d) <> 0)
SELECT doc_id, coalesce(list(n || ' ' || token ORDER BY token) FILTER (n > 0), []) AS lost, coalesce(list(-n || ' ' || token ORDER BY token) FILTER (n < 0), []) AS added, any_value(s = t) AS in_order FROM l LEFT JOIN n USING (doc_id) GROUP BY doc_id""")
def layout_losses(spark, sf_dir):
    """Numbers, addresses and links lost and added, each as often as it is, in translations that lose, move, change or keep some."""
    text, by = F.col("text"), F.col("doc_id") % 4
    moved, changed = F.concat(F.lit("a@b.cd 1,5 7 "), text, F.lit(" 7 7")), F.concat(F.replace(text, F.lit("1"), F.lit("2")), F.lit(" 7 7 7 7 1,5"))
    target = F.when(by == 0, F.concat(text, F.lit(" 7 1,5 a@b.cd"))).when(by == 1, moved).when(by == 2, changed).otherwise(F.concat(text, F.lit(" 7 7 7 1,5 a@b.cd")))
    pairs = fx.table(spark, sf_dir, "documents").select("doc_id", F.concat(text, F.lit(" 7 7 7 1,5 a@b.cd")).alias("source"), target.alias("target"))
    told = lambda c: F.transform(c, lambda x: F.concat_ws(" ", x["n"].cast("string"), x["token"]))
    return translation.layout_losses(pairs).select("doc_id", told("lost").alias("lost"), told("added").alias("added"), "in_order")


@query(f"""WITH RECURSIVE {fx.LINE_SEGS}, {fx.BATCHES}, s AS (SELECT count(*) AS texts, count(DISTINCT (doc_id, batch_id)) AS batches FROM b)
SELECT 'segments' AS step, texts AS rows, NULL::BIGINT AS texts, NULL::BIGINT AS errors FROM s UNION ALL SELECT 'assigned', texts, NULL, NULL FROM s
UNION ALL SELECT 'batches', batches, texts, NULL FROM s UNION ALL SELECT 'answers', batches, texts, 0 FROM s""")
def live_progress(spark, sf_dir):
    """What each step of a translation told when it ended, counted as it ran."""
    folder, watched = own_folder(spark, "progress"), progress.Progress(spark)

    def save(df, label):
        df.write.parquet(f"{folder}/{label}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{label}")

    keep = watched.saver(save)
    work = keep(translation.split_blank(fx.line_segments(spark, sf_dir))[0], "segments")
    assigned = keep(translation.assign_batches(work), "assigned")
    keep(translators.pseudo(keep(translation.gather_batches(work, assigned), "batches"), translation.JobConfig("", "")), "answers")
    watched.stop()
    return watched.table()
