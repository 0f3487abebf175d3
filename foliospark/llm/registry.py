"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, decontam, html, mixing, neardup, pii, quality, secrets, tokens, vectors

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_decontamination": decontam.op2_decontamination,
    "op3_chat_windows": chat.op3_chat_windows,
    "op4_minhash_neardup": neardup.op4_minhash_neardup,
    "op5_mixing": mixing.op5_mixing,
    "op6_quality_gam": quality.op6_quality_gam,
    "op7_token_shards": tokens.op7_token_shards,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_lattice_neardup": vectors.op9_lattice_neardup,
    "op10_html_text": html.op10_html_text,
}
ORACLE_SQL: dict[str, str] = {"op3_chat_windows": chat.OP3_SQL, "op5_mixing": mixing.OP5_SQL}
