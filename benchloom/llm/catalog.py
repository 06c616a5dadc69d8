"""The queries of the llm operators and their oracle SQL (DuckDB)."""

from . import chat_format, decontamination, embedding_dedup, language_id, license_scan, merkle, mixing, overlap_join, packing, simhash, substring_dedup, suffix_dedup, url_filter

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_simhash_near_dedup": simhash.op5_simhash_near_dedup,
    "op6_temperature_mixing": mixing.op6_temperature_mixing,
    "op7_license_scan": license_scan.op7_license_scan,
    "op8_embedding_dedup": embedding_dedup.op8_embedding_dedup,
    "op9_chat_format": chat_format.op9_chat_format,
    "op10_decontamination": decontamination.op10_decontamination,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_overlap_join": overlap_join.op12_overlap_join,
    "op13_packing": packing.op13_packing,
}

#: A trained network, XXH64 and a tokenizer have no SQL form here: operators 1, 5 and 13 are tested against brute force.
ORACLE_SQL = {
    "op2_url_filter": url_filter.ORACLE,
    "op3_substring_dedup": substring_dedup.ORACLE,
    "op4_suffix_dedup": suffix_dedup.ORACLE,
    "op6_temperature_mixing": mixing.ORACLE,
    "op7_license_scan": license_scan.ORACLE,
    "op8_embedding_dedup": embedding_dedup.ORACLE,
    "op9_chat_format": chat_format.ORACLE,
    "op10_decontamination": decontamination.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op12_overlap_join": overlap_join.ORACLE,
}
