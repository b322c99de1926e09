"""Queries of the text operators and the SQL that must give the same rows."""

from __future__ import annotations

from . import audio, chat, decontaminate, hmm, lines, near_dedup, packing, quality, substrings, token_counts

QUERIES = {
    "op1_best_fit_packing": packing.query,
    "op2_token_counts": token_counts.query,
    "op3_chat_windows": chat.query,
    "op4_quality": quality.query,
    "op5_remove_repeats": substrings.query,
    "op6_hmm_scores": hmm.query,
    "op7_decontaminate": decontaminate.query,
    "op8_audio_features": audio.query,
    "op9_near_duplicates": near_dedup.query,
    "op10_line_dedup": lines.query,
}
SQL: dict[str, str] = {"op7_decontaminate": decontaminate.SQL}
