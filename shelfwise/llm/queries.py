"""Registered queries of the training-text operators and their check SQL."""

from __future__ import annotations

from .alignment import op11_token_alignment
from .conversations import op12_conversation_repair
from .dac import op10_token_files
from .decontaminate import op7_decontamination
from .embeddings import op1_embedding_dedup
from .jaccard import op8_jaccard_join
from .licenses import op5_license_scan
from .lines import op4_line_dedup
from .reputation import ORACLE as OP9_ORACLE
from .reputation import op9_url_filter
from .sentencepiece_codec import op2_sentencepiece
from .spotsigs import op13_spot_fingerprints
from .token_counts import op6_token_counts
from .toxicity import op3_toxicity

QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_toxicity": op3_toxicity,
    "op4_line_dedup": op4_line_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_token_counts": op6_token_counts,
    "op7_decontamination": op7_decontamination,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_url_filter": op9_url_filter,
    "op10_token_files": op10_token_files,
    "op11_token_alignment": op11_token_alignment,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_spot_fingerprints": op13_spot_fingerprints,
}

ORACLES = {"op9_url_filter": OP9_ORACLE}
