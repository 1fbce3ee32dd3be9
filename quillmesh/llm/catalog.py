"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from quillmesh.llm import chat, exact, fim, langid, lines, merkle, mixing, packing, quality, similarity, substrings, toxicity, warc

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_packing": packing.op2_packing,
    "op3_chat": chat.op3_chat,
    "op4_substrings": substrings.op4_substrings,
    "op5_warc": warc.op5_warc,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_exact_dedup": exact.op7_exact_dedup,
    "op8_jaccard_join": similarity.op8_jaccard_join,
    "op9_quality": quality.op9_quality,
    "op10_mixing": mixing.op10_mixing,
    "op11_fim": fim.op11_fim,
    "op12_lines": lines.op12_lines,
    "op13_merkle": merkle.op13_merkle,
}

ORACLES = {
    "op3_chat": chat.ORACLE,
    "op5_warc": warc.ORACLE,
    "op7_exact_dedup": exact.ORACLE,
    "op10_mixing": mixing.ORACLE,
    "op11_fim": fim.ORACLE,
    "op12_lines": lines.ORACLE,
    "op13_merkle": merkle.ORACLE,
}
