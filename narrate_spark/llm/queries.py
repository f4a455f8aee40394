"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from narrate_spark.llm import chat, decontaminate, licenses, mixing, near_dedup, packing, quality, runs, search, token_files, url_filter, warc, whitening

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_quality": quality.op2_quality,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_search": search.op4_search,
    "op5_warc": warc.op5_warc,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_licenses": licenses.op7_licenses,
    "op8_token_files": token_files.op8_token_files,
    "op9_chat_format": chat.op9_chat_format,
    "op10_packing": packing.op10_packing,
    "op11_whitening": whitening.op11_whitening,
    "op12_runs": runs.op12_runs,
    "op13_mixing": mixing.op13_mixing,
}
ORACLES = {
    "op3_decontamination": decontaminate.ORACLE_SQL,
    "op4_search": search.ORACLE_SQL,
    "op9_chat_format": chat.ORACLE_SQL,
}
