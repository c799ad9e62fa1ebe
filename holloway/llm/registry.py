"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import alignment, chat, decontaminate, exact_dedup, fingerprints, html_extract, lang_id, pii, sentencepiece, sharding, simhash, spelling, token_counts

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_chat_format": chat.op2_chat_format,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_sentencepiece": sentencepiece.op4_sentencepiece,
    "op5_pii": pii.op5_pii,
    "op6_html_extract": html_extract.op6_html_extract,
    "op7_lang_id": lang_id.op7_lang_id,
    "op8_simhash": simhash.op8_simhash,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_alignment": alignment.op11_alignment,
    "op12_fingerprints": fingerprints.op12_fingerprints,
    "op13_spelling": spelling.op13_spelling,
}

ORACLES = {
    "op2_chat_format": chat.ORACLE,
    "op9_exact_dedup": exact_dedup.ORACLE,
    "op10_decontaminate": decontaminate.ORACLE,
}
