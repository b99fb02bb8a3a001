"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from tonguemill.llm import bpe, divergence, jaccard, langid, licenses, packing, personal, quality, substrings, urls, vectors, warc, whitening

QUERIES = {
    "op1_license_scan": licenses.query,
    "op2_byte_bpe": bpe.query,
    "op3_url_filter": urls.query,
    "op4_language_id": langid.query,
    "op5_ngram_jaccard": jaccard.query,
    "op6_quality_rules": quality.query,
    "quality_ablations": quality.ablation_query,
    "op7_best_fit_packing": packing.query,
    "op8_substring_dedup": substrings.query,
    "op9_embedding_near_dedup": vectors.query,
    "op10_warc": warc.query,
    "op11_personal_data": personal.query,
    "op12_source_divergence": divergence.query,
    "op13_embedding_whitening": whitening.query,
}
SQL = {
    "op3_url_filter": urls.SQL,
    "op5_ngram_jaccard": jaccard.SQL,
    "op6_quality_rules": quality.SQL,
    "quality_ablations": quality.ABLATION_SQL,
    "op8_substring_dedup": substrings.SQL,
    "op9_embedding_near_dedup": vectors.SQL,
    "op10_warc": warc.SQL,
    "op12_source_divergence": divergence.SQL,
}
