"""The queries and oracle SQL of this subpackage."""

from __future__ import annotations

from . import linechunks, linkgraph, secrets
from .audio import op9_wav_fingerprints
from .bpe import op1_byte_bpe
from .decontamination import op4_qgram_decontamination
from .importance import op7_importance_resampling
from .linechunks import op10_line_chunks
from .linkgraph import op5_link_trust
from .minjoin import op2_jaccard_join
from .secrets import op3_secret_ownership
from .sharding import op8_virtual_slots
from .suffixes import op6_suffix_dedup

QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_secret_ownership": op3_secret_ownership,
    "op4_qgram_decontamination": op4_qgram_decontamination,
    "op5_link_trust": op5_link_trust,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_importance_resampling": op7_importance_resampling,
    "op8_virtual_slots": op8_virtual_slots,
    "op9_wav_fingerprints": op9_wav_fingerprints,
    "op10_line_chunks": op10_line_chunks,
}

#: Null where SQL can't express an operator; those are tested against brute force.
ORACLES: dict[str, str] = {
    "op3_secret_ownership": secrets.ORACLE,
    "op5_link_trust": linkgraph.ORACLE,
    "op10_line_chunks": linechunks.ORACLE,
}
