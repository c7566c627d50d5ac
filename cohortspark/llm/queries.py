"""The text operators' registered queries, and SQL for those that SQL can express."""

from __future__ import annotations

from . import decontaminate, jaccard, licences, rules, vectors
from .decontaminate import op2_decontamination
from .jaccard import op8_jaccard
from .katz import op3_katz
from .langid import op4_language
from .licences import op5_licences
from .mixing import op9_mixing
from .periodic import op11_periodic
from .quality import op10_quality
from .rules import op12_rules
from .suffix import op6_suffix
from .toxicity import op1_toxicity
from .vectors import op7_vectors
from .whitening import op13_whitening

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_decontamination": op2_decontamination,
    "op3_katz": op3_katz,
    "op4_language": op4_language,
    "op5_licences": op5_licences,
    "op6_suffix": op6_suffix,
    "op7_vectors": op7_vectors,
    "op8_jaccard": op8_jaccard,
    "op9_mixing": op9_mixing,
    "op10_quality": op10_quality,
    "op11_periodic": op11_periodic,
    "op12_rules": op12_rules,
    "op13_whitening": op13_whitening,
}
ORACLES = {"op2_decontamination": decontaminate.ORACLE, "op5_licences": licences.oracle(), "op7_vectors": vectors.ORACLE, "op8_jaccard": jaccard.ORACLE, "op12_rules": rules.oracle()}
