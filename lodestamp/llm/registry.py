"""The queries of this subpackage for the driver's entry module, and their SQL where SQL can say the same."""

from __future__ import annotations

from . import ann, bpe, chat, kmeans, langid, lexical, linededup, mixing, quality, ring, simhash, suffixes, toxicity

QUERIES = {
    "op1_suffix_dedup": suffixes.query,
    "op2_line_dedup": linededup.query,
    "op3_chat_format": chat.query,
    "op4_bpe": bpe.query,
    "op5_nearest": ann.query,
    "op6_quality": quality.query,
    "op7_toxicity": toxicity.query,
    "op8_mixing": mixing.query,
    "op9_simhash": simhash.query,
    "op10_language": langid.query,
    "op11_lexical_search": lexical.query,
    "op12_hash_ring": ring.query,
    "op13_kmeans": kmeans.query,
}

ORACLES = {
    "op2_line_dedup": linededup.SQL,
    "op3_chat_format": chat.SQL,
    "op8_mixing": mixing.SQL,
    "op11_lexical_search": lexical.SQL,
    "op12_hash_ring": ring.SQL,
    "op13_kmeans": kmeans.SQL,
}
