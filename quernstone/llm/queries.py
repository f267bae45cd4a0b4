"""The registered queries of the training-data operators, and SQL where it can express them."""

from quernstone.llm import language, lines, media, mixing, pitman_yor, sentencepieces, simhash, token_shards, topk, toxicity

QUERIES = {
    "op1_simhash_near_dedup": simhash.query,
    "op2_line_dedup": lines.query,
    "op3_token_shards": token_shards.query,
    "op4_sentencepiece": sentencepieces.query,
    "op5_pitman_yor_score": pitman_yor.query,
    "op6_toxicity": toxicity.query,
    "op7_mix_sources": mixing.query,
    "op8_language_id": language.query,
    "op9_media_columns": media.query,
    "op10_bm25_top_k": topk.query,
}

ORACLES: dict[str, str] = {
    "op7_mix_sources": mixing.ORACLE,
    "op10_bm25_top_k": topk.ORACLE,
}
