"""Queries of this subpackage by name, and DuckDB SQL for those SQL can express."""

from __future__ import annotations

from . import ann, bpe, chat, decontaminate, langid, lengths, repeats, simhash, toxicity, urls


def queries() -> dict:
    found = [
        chat.op1_chat_format,
        ann.op2_multi_index,
        urls.op3_url_filter,
        lengths.op4_length_histogram,
        decontaminate.op5_decontaminate,
        simhash.op6_simhash_tiles,
        langid.op7_language_id,
        bpe.op8_byte_bpe,
        toxicity.op9_toxicity,
        repeats.op10_repeat_dedup,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": chat.ORACLE, "op3_url_filter": urls.ORACLE, "op5_decontaminate": decontaminate.ORACLE}
