"""Registered queries of the training-data operators and their SQL where SQL can express them."""

from __future__ import annotations

from pathloom.llm import audit, language, lines, media, middle, mixing, packing, sharding, simhash, suffixes, urls, vectors, winnowing

QUERIES = {
    "op1_line_dedup": lines.op1_line_dedup,
    "op2_ring_shards": sharding.op2_ring_shards,
    "op3_media_columns": media.op3_media_columns,
    "op4_pack_sequences": packing.op4_pack_sequences,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_winnowing": winnowing.op6_winnowing,
    "op7_suffix_dedup": suffixes.op7_suffix_dedup,
    "op8_simhash_near_dedup": simhash.op8_simhash_near_dedup,
    "op9_url_filters": urls.op9_url_filters,
    "op10_language_id": language.op10_language_id,
    "op11_fill_in_middle": middle.op11_fill_in_middle,
    "op12_embedding_near_dedup": vectors.op12_embedding_near_dedup,
    "op13_source_divergence": audit.op13_source_divergence,
}

ORACLES = {
    "op1_line_dedup": lines.OP1_SQL,
    "op5_mix_sources": mixing.OP5_SQL,
    "op9_url_filters": urls.OP9_SQL,
    "op11_fill_in_middle": middle.OP11_SQL,
    "op12_embedding_near_dedup": vectors.OP12_SQL,
    "op13_source_divergence": audit.OP13_SQL,
}
