"""The training-data queries and their SQL."""

from __future__ import annotations

from loomtext.llm import bpe, decontam, exact, fim, langid, lm, merkle, pii, repeats, secrets, simhash, tokens, urls

QUERIES = {
    "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
    "op2_language_id": langid.op2_language_id,
    "op3_pii": pii.op3_pii,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_token_counts": tokens.op5_token_counts,
    "op6_repeated_substrings": repeats.op6_repeated_substrings,
    "op7_lm_scores": lm.op7_lm_scores,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_decontamination": decontam.op9_decontamination,
    "op10_exact_dedup": exact.op10_exact_dedup,
    "op11_fill_in_middle": fim.op11_fill_in_middle,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_url_filter": urls.op13_url_filter,
}
ORACLES = {"op8_secret_scan": secrets.ORACLE, "op10_exact_dedup": exact.ORACLE, "op11_fill_in_middle": fim.ORACLE, "op12_merkle_manifest": merkle.ORACLE}
