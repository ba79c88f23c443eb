"""The subpackage's registered queries and their DuckDB equivalents."""

from quillmark.llm import decontaminate, language, line_dedup, mixing, near_dedup, pii, quality, suffix_dedup, token_counts, warc

QUERIES = {
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op10_near_duplicates": near_dedup.op10_near_duplicates,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op9_personal_data": pii.op9_personal_data,
    "op8_language_id": language.op8_language_id,
    "op1_source_mixing": mixing.op1_source_mixing,
    "op4_benchmark_decontamination": decontaminate.op4_benchmark_decontamination,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_warc_archives": warc.op6_warc_archives,
    "op7_quality_rules": quality.op7_quality_rules,
}
ORACLE = {
    "op2_line_dedup": line_dedup.ORACLE,
    "op3_suffix_dedup": suffix_dedup.ORACLE,
    "op4_benchmark_decontamination": decontaminate.ORACLE,
    "op6_warc_archives": warc.ORACLE,
    "op7_quality_rules": quality.ORACLE,
}
