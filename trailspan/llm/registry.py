"""Queries of this subpackage and the SQL that must give the same rows."""

from __future__ import annotations

from trailspan.llm.brown import op2_brown_lm
from trailspan.llm.html import op4_layout_text
from trailspan.llm.minhash import op7_super_minhash
from trailspan.llm.mixing import OP1_SQL, op1_token_mix
from trailspan.llm.naming import OP11_SQL, op11_block_names
from trailspan.llm.pieces import op9_viterbi_pieces
from trailspan.llm.pii import op10_bilstm_pii
from trailspan.llm.quality import op6_isolation_quality
from trailspan.llm.resampling import op12_trie_resampling
from trailspan.llm.tokens import op3_zstd_tokens
from trailspan.llm.topk import OP5_SQL, op5_impact_topk
from trailspan.llm.toxicity import op8_crf_toxicity
from trailspan.llm.vafile import OP13_SQL, op13_va_negatives

QUERIES = {
    f.__name__: f
    for f in (
        op1_token_mix, op2_brown_lm, op3_zstd_tokens, op4_layout_text, op5_impact_topk, op6_isolation_quality, op7_super_minhash,
        op8_crf_toxicity, op9_viterbi_pieces, op10_bilstm_pii, op11_block_names, op12_trie_resampling, op13_va_negatives,
    )
}
ORACLES: dict[str, str] = {"op1_token_mix": OP1_SQL, "op5_impact_topk": OP5_SQL, "op11_block_names": OP11_SQL, "op13_va_negatives": OP13_SQL}
