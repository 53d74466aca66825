"""The queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from . import decontaminate, langid, line_dedup, minhash, phrases, pieces, quality, sharding, substring_dedup, suffix_array, toxicity, warc, whitening

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_sharding": sharding.op3_sharding,
    "op4_warc": warc.op4_warc,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_suffix_array": suffix_array.op7_suffix_array,
    "op8_sentencepiece": pieces.op8_sentencepiece,
    "op9_minhash": minhash.op9_minhash,
    "op10_langid": langid.op10_langid,
    "op11_whitening": whitening.op11_whitening,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_collocations": phrases.op13_collocations,
}
ORACLES = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op2_substring_dedup": substring_dedup.ORACLE,
    "op3_sharding": sharding.ORACLE,
    "op4_warc": warc.ORACLE,
    "op5_decontamination": decontaminate.ORACLE,
    "op6_quality_rules": quality.ORACLE,
    "op7_suffix_array": suffix_array.ORACLE,
    "op9_minhash": minhash.ORACLE,
    "op13_collocations": phrases.ORACLE,
}
