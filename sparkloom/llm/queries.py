"""The registered queries of this package and the SQL for those that SQL can express."""

from __future__ import annotations

from sparkloom.llm.chat import OP3_SQL, op3_chat_format
from sparkloom.llm.embedding_dedup import op6_embedding_dedup
from sparkloom.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from sparkloom.llm.line_dedup import OP9_SQL, op9_line_dedup
from sparkloom.llm.media import op5_media
from sparkloom.llm.mixing import op1_mixing, op1_sql
from sparkloom.llm.near_dedup import op10_near_dedup
from sparkloom.llm.packing import op7_packing
from sparkloom.llm.phrases import OP13_SQL, op13_phrases
from sparkloom.llm.pieces import op12_pieces
from sparkloom.llm.quality import op8_quality
from sparkloom.llm.token_counts import op2_token_counts
from sparkloom.llm.url_filter import OP4_SQL, op4_url_filter


def queries() -> dict:
    found = [op1_mixing, op2_token_counts, op3_chat_format, op4_url_filter, op5_media, op6_embedding_dedup, op7_packing, op8_quality, op9_line_dedup, op10_near_dedup, op11_hard_negatives, op12_pieces, op13_phrases]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": op1_sql(), "op3_chat_format": OP3_SQL, "op4_url_filter": OP4_SQL, "op9_line_dedup": OP9_SQL, "op11_hard_negatives": OP11_SQL, "op13_phrases": OP13_SQL}
