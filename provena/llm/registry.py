"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import bpe, chat, decontaminate, fim, hash_forest, language, main_text, quality, simhash, spelling, suffix_dedup, token_files, toxicity

QUERIES = {
    "op1_decontaminate": decontaminate.query,
    "op2_main_text": main_text.query,
    "op3_simhash": simhash.query,
    "op4_chat": chat.query,
    "op5_toxicity": toxicity.query,
    "op6_token_files": token_files.query,
    "op7_byte_bpe": bpe.query,
    "op8_suffix_dedup": suffix_dedup.query,
    "op9_hash_forest": hash_forest.query,
    "op10_language": language.query,
    "op11_quality": quality.query,
    "op12_spelling": spelling.query,
    "op13_fim": fim.query,
}
SQL = {"op1_decontaminate": decontaminate.SQL, "op4_chat": chat.SQL, "op12_spelling": spelling.SQL, "op13_fim": fim.SQL}
