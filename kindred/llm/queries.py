"""The registered queries of the subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from kindred.llm import chat_format, decontaminate, embedding_forest, fill_in_middle, language_id, lm_score, minhash_forest, packing, periodic_runs, revisits, substring_dedup, token_output, toxicity

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_chat_format": chat_format.op3_chat_format,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_packing": packing.op5_packing,
    "op6_revisits": revisits.op6_revisits,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_embedding_forest": embedding_forest.op8_embedding_forest,
    "op9_minhash_forest": minhash_forest.op9_minhash_forest,
    "op10_lm_score": lm_score.op10_lm_score,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
    "op13_token_output": token_output.op13_token_output,
}
ORACLES = {
    "op2_substring_dedup": substring_dedup.ORACLE,
    "op3_chat_format": chat_format.ORACLE,
    "op6_revisits": revisits.ORACLE,
    "op7_decontaminate": decontaminate.ORACLE,
    "op10_lm_score": lm_score.ORACLE,
    "op12_fill_in_middle": fill_in_middle.ORACLE,
}
