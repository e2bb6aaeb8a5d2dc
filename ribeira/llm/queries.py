"""The queries of this subpackage and, where SQL can say them, their SQL."""

from __future__ import annotations

from ribeira.llm import bpe, decontaminate, exact_dedup, importance, language, pair_index, quality, simhash, substring_dedup, token_count, toxicity, warc, whitening

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_warc": warc.op2_warc,
    "op6_toxicity": toxicity.op6_toxicity,
    "op10_quality": quality.op10_quality,
    "op8_language": language.op8_language,
    "op9_simhash": simhash.op9_simhash,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_token_counts": token_count.op4_token_counts,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op11_whitening": whitening.op11_whitening,
    "op12_bpe": pair_index.op12_bpe,
    "op13_resample": importance.op13_resample,
}
SQL = {"op3_decontaminate": decontaminate.OP3_SQL, "op2_warc": warc.OP2_SQL, "op5_exact_dedup": exact_dedup.OP5_SQL}
