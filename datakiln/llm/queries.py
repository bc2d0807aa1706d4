"""The registered queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from datakiln.llm import (
    language_id,
    lexical_search,
    line_rules,
    line_templates,
    minhash,
    mixing,
    pieces,
    sharding,
    simhash,
    token_store,
    topk_search,
    warc,
    whitening,
)

QUERIES = {
    "op1_token_store": token_store.op1_token_store,
    "op2_warc": warc.op2_warc,
    "op3_language_id": language_id.op3_language_id,
    "op4_line_templates": line_templates.op4_line_templates,
    "op5_sentencepiece": pieces.op5_sentencepiece,
    "op6_topk": topk_search.op6_topk,
    "op7_extendible_shards": sharding.op7_extendible_shards,
    "op8_line_frequency": line_rules.op8_line_frequency,
    "op9_mixing": mixing.op9_mixing,
    "op10_simhash": simhash.op10_simhash,
    "op11_wand": lexical_search.op11_wand,
    "op12_whitening": whitening.op12_whitening,
    "op13_minhash": minhash.op13_minhash,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc": warc.OP2_SQL,
    "op6_topk": topk_search.OP6_SQL,
    "op7_extendible_shards": sharding.OP7_SQL,
    "op8_line_frequency": line_rules.OP8_SQL,
    "op11_wand": lexical_search.OP11_SQL,
}
