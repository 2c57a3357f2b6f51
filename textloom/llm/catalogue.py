"""The queries of the training-data operators and their DuckDB counterparts."""

from textloom.llm import decontaminate, langid, licenses, line_dedup, mixing, pii, quality, repeats, simhash, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_licenses": licenses.op3_licenses,
    "op4_langid": langid.op4_langid,
    "op5_quality": quality.op5_quality,
    "op6_mix": mixing.op6_mix,
    "op7_pii": pii.op7_pii,
    "op8_repeated_bytes": repeats.op8_repeated_bytes,
    "op9_simhash": simhash.op9_simhash,
    "op10_decontaminate": decontaminate.op10_decontaminate,
}
SQL = {"op1_line_dedup": line_dedup.SQL, "op3_licenses": licenses.SQL, "op6_mix": mixing.SQL, "op5_quality": quality.SQL, "op7_pii": pii.SQL, "op10_decontaminate": decontaminate.SQL}
