"""The numbered operators as queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from . import collocations, decontaminate, importance, languages, mixing, perplexity, pii, quality, sharding, simhash, tokens, urls, warc

QUERIES = {
    "op1_mix_sources": mixing.op1,
    "op2_shard_compaction": sharding.op2,
    "op3_perplexity_rules": perplexity.op3,
    "op4_passage_attention": quality.op4,
    "op5_personal_data": pii.op5,
    "op6_decontaminate": decontaminate.op6,
    "op7_token_counts": tokens.op7,
    "op8_simhash_groups": simhash.op8,
    "op9_url_vocabulary": urls.op9,
    "op10_warc_salvage": warc.op10,
    "op11_importance_resampling": importance.op11,
    "op12_language_filters": languages.op12,
    "op13_collocations": collocations.op13,
}

ORACLE_SQL = {
    "op1_mix_sources": mixing.OP1_SQL,
    "op6_decontaminate": decontaminate.OP6_SQL,
    "op9_url_vocabulary": urls.OP9_SQL,
    "op11_importance_resampling": importance.OP11_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
