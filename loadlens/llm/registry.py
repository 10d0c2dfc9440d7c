"""The queries of this subpackage and their SQL."""

from loadlens.llm import decontaminate, linededup, lmscore, mixing, neardup, quality, secrets, sharding, tokencount, warc

QUERIES = {
    "op1_stupid_backoff": lmscore.query,
    "op2_token_counts": tokencount.query,
    "op3_quality_rules": quality.query,
    "op4_minhash_near_dedup": neardup.query,
    "op5_weighted_hash_tree": sharding.query,
    "op6_warc_reassembly": warc.query,
    "op7_secret_forest": secrets.query,
    "op8_benchmark_decontamination": decontaminate.query,
    "op9_line_dedup": linededup.query,
    "op10_pareto_mixing": mixing.query,
}

ORACLES = {
    "op1_stupid_backoff": lmscore.ORACLE_SQL,
    "op4_minhash_near_dedup": neardup.ORACLE_SQL,
    "op5_weighted_hash_tree": sharding.ORACLE_SQL,
    "op6_warc_reassembly": warc.ORACLE_SQL,
    "op8_benchmark_decontamination": decontaminate.ORACLE_SQL,
    "op9_line_dedup": linededup.ORACLE_SQL,
    "op10_pareto_mixing": mixing.ORACLE_SQL,
    "op3_quality_rules": quality.ORACLE_SQL,
}
