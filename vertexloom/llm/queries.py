"""Queries of the corpus operators, and their SQL."""

from . import htmlmain, mixing, oracles, pii, runindex, secretscan, sharding, telephony, toxicity, triejoin, winnow


def queries() -> dict:
    every = [
        mixing.op1_mix_sources,
        toxicity.op2_toxic_segments,
        secretscan.op3_secret_scan,
        triejoin.op4_jaccard_trie_join,
        sharding.op5_rendezvous_shards,
        winnow.op6_winnowing,
        pii.op7_personal_data,
        telephony.op8_telephony_media,
        htmlmain.op9_main_text,
        runindex.op10_run_length_index,
    ]
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mix_sources": mixing.OP1_SQL,
        "op3_secret_scan": oracles.OP3_SQL,
        "op4_jaccard_trie_join": oracles.OP4_SQL,
        "op5_rendezvous_shards": oracles.OP5_SQL,
        "op6_winnowing": oracles.OP6_SQL,
        "op7_personal_data": oracles.OP7_SQL,
        "op8_telephony_media": oracles.OP8_SQL,
        "op10_run_length_index": oracles.OP10_SQL,
    }
