"""The registered queries of the operators, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe_codec, embedding_dedup, html_text, language_id, minhash_dedup, mixing, tiff, token_count, toxicity, url_filter

QUERIES = {
    "op1_token_counts": token_count.op1,
    "op2_mixing": mixing.op2,
    "op3_tiff": tiff.op3,
    "op4_url_filter": url_filter.op4,
    "op5_toxicity": toxicity.op5,
    "op6_language_id": language_id.op6,
    "op7_embedding_dedup": embedding_dedup.op7,
    "op8_bpe_codec": bpe_codec.op8,
    "op9_minhash_dedup": minhash_dedup.op9,
    "op10_html_text": html_text.op10,
}
ORACLES: dict[str, str] = {"op2_mixing": mixing.SQL}
