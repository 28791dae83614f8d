"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import alignment, hard_negatives, langid, media, mixing, packing, quality, sentencepieces, simhash, topk, toxicity, url_filter, warc

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_simhash_near_dedup": simhash.op3_simhash_near_dedup,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_exact_topk": topk.op5_exact_topk,
    "op6_media_columns": media.op6_media_columns,
    "op7_language_id": langid.op7_language_id,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_warc": warc.op9_warc,
    "op10_quality": quality.op10_quality,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_sentencepiece": sentencepieces.op12_sentencepiece,
    "op13_cross_tokenizer": alignment.op13_cross_tokenizer,
}

ORACLE_SQL = {
    "op1_mix_sources": mixing.ORACLE_OP1,
    "op5_exact_topk": topk.ORACLE_OP5,
    "op9_warc": warc.ORACLE_OP9,
    "op11_hard_negatives": hard_negatives.ORACLE_OP11,
}
