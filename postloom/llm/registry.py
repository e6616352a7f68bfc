"""The numbered operators' queries and the SQL that gives the same rows, where SQL can express them."""

from __future__ import annotations

from ..session import shipped
from . import oracles
from .op1_minhash import op1_minhash
from .op2_packing import op2_packing
from .op3_pstable import op3_pstable
from .op4_mpeg_ts import op4_mpeg_ts
from .op5_toxicity import op5_toxicity
from .op6_token_counts import op6_token_counts
from .op7_suffix_index import op7_suffix_index
from .op8_line_crf import op8_line_crf
from .op9_html_trees import op9_html_trees
from .op10_chunked_bpe import op10_chunked_bpe
from .op11_repair_grammar import op11_repair_grammar
from .op12_fim_skiplist import op12_fim_skiplist
from .op13_event_chat import op13_event_chat

_QUERIES = [op1_minhash, op2_packing, op3_pstable, op4_mpeg_ts, op5_toxicity, op6_token_counts, op7_suffix_index, op8_line_crf, op9_html_trees, op10_chunked_bpe, op11_repair_grammar, op12_fim_skiplist, op13_event_chat]


def queries():
    return {q.__name__: shipped(q) for q in _QUERIES}


def oracle_sql():
    return {"op1_minhash": oracles.OP1, "op3_pstable": oracles.OP3, "op7_suffix_index": oracles.OP7, "op11_repair_grammar": oracles.OP11, "op12_fim_skiplist": oracles.OP12, "op13_event_chat": oracles.OP13}
