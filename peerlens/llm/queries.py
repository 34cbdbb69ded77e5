"""The queries of this folder by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, langid, linededup, manifest, mixing, neardup, packing, repair, syncmers, tokens, toxicity, warc, webpstore

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_mixing": mixing.op2_mixing,
    "op3_warc": warc.op3_warc,
    "op4_webp": webpstore.op4_webp,
    "op5_line_dedup": linededup.op5_line_dedup,
    "op6_token_counts": tokens.op6_token_counts,
    "op7_fingerprints": syncmers.op7_fingerprints,
    "op8_near_duplicates": neardup.op8_near_duplicates,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_chat_formatting": chat.op11_chat_formatting,
    "op12_merkle_manifest": manifest.op12_merkle_manifest,
    "op13_conversation_repair": repair.op13_conversation_repair,
}
ORACLES = {
    "op2_mixing": mixing.ORACLE,
    "op3_warc": warc.ORACLE,
    "op5_line_dedup": linededup.ORACLE,
    "op8_near_duplicates": neardup.ORACLE,
    "op11_chat_formatting": chat.ORACLE,
    "op12_merkle_manifest": manifest.ORACLE,
    "op13_conversation_repair": repair.ORACLE,
}
