"""The registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from tablekeel.llm import chat_format, decontaminate, embedding_graph, filter_audit, language_id, line_dedup, packing, paragraph_sketch, quality, sharding, simhash, url_filter, vector_codes

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_language_id": language_id.op2_language_id,
    "op3_simhash": simhash.op3_simhash,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_chat_format": chat_format.op5_chat_format,
    "op6_sharding": sharding.op6_sharding,
    "op7_fingerprints": paragraph_sketch.op7_fingerprints,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_packing": packing.op9_packing,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_embedding_dedup": embedding_graph.op13_embedding_dedup,
}
ORACLE_SQL = {"op4_line_dedup": line_dedup.OP4_SQL, "op5_chat_format": chat_format.OP5_SQL, "op11_vector_codes": vector_codes.OP11_SQL, "op12_filter_audit": filter_audit.OP12_SQL}
