"""What the language stage tells reaches the packed pieces, and it leaves no other operator's cache in its workers."""

import corpus_pipeline
from tonguemill.llm import common, langid


def test_predicted_language_reaches_the_pieces(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    text = docs.where("lang = 'de' and n_chars > 400").orderBy("doc_id").first().text
    odd = spark.createDataFrame([(30_000, text, None, "s", 1), (30_001, text, "en", "s", 1), (30_002, "q", "xx", "s", 1)], docs.schema)
    told = corpus_pipeline.language(spark, docs.union(odd), data).where("doc_id >= 30000")
    packed = corpus_pipeline.best_fit_packing(spark, told, data)
    got = {r.doc_id: r.lang for r in packed.select("doc_id", "lang").distinct().collect()}
    assert got[30_000] == got[30_001] == "de" and set(got) == {30_000, 30_001, 30_002}
    assert packed.columns[:3] == ["doc_id", "lang", "piece"]


def test_other_caches_go():
    common.worker_cache("packing", lambda: "a tokenizer")
    assert list(langid._counts(iter([]))) == [] and "packing" not in common._kept
