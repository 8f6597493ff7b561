"""Queries of the corpus operators, for the registry."""

from __future__ import annotations

import corpus_pipeline

from .chat import OP9_SQL, op9_chat
from .exact_dedup import OP1_SQL, op1_exact_dedup
from .language_id import op7_language_id
from .licenses import op8_licenses
from .line_dedup import op10_line_dedup
from .mixing import op6_mixing
from .near_dedup import OP4_SQL, op4_near_dedup
from .packing import op5_packing
from .phrases import OP13_SQL, op13_collocations
from .quality_rules import OP12_SQL, op12_quality_rules
from .topk import OP3_SQL, op3_topk
from .toxicity import op2_toxicity
from .whitening import op11_whitening

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_toxicity": op2_toxicity,
    "op7_language_id": op7_language_id,
    "op3_topk": op3_topk,
    "op8_licenses": op8_licenses,
    "op9_chat": op9_chat,
    "op4_near_dedup": op4_near_dedup,
    "op5_packing": op5_packing,
    "op6_mixing": op6_mixing,
    "op10_line_dedup": op10_line_dedup,
    "op11_whitening": op11_whitening,
    "op12_quality_rules": op12_quality_rules,
    "op13_collocations": op13_collocations,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {
    "op1_exact_dedup": OP1_SQL,
    "op3_topk": OP3_SQL,
    "op4_near_dedup": OP4_SQL,
    "op9_chat": OP9_SQL,
    "op12_quality_rules": OP12_SQL,
    "op13_collocations": OP13_SQL,
    **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}),
}
