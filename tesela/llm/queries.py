"""The thin queries of the subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from .audit import OP13_SQL, op13
from .crf import op2
from .lines import OP5_SQL, op5
from .minhash import op4
from .mixing import op7
from .negatives import OP12_SQL, op12
from .ngrams import op11
from .packing import op9
from .rules import op1
from .substrings import OP10_SQL, op10
from .surrogates import op6
from .toxicity import op8
from .vafile import OP3_SQL, op3

QUERIES = {
    "op1_quality_rules": op1,
    "op2_quality_classifier": op2,
    "op3_exact_top_k": op3,
    "op4_minhash_near_dedup": op4,
    "op5_line_dedup": op5,
    "op6_pii_surrogates": op6,
    "op7_soft_mixing": op7,
    "op8_toxicity": op8,
    "op9_mixture_packing": op9,
    "op10_substring_dedup": op10,
    "op11_ngram_trie_lm": op11,
    "op12_hard_negatives": op12,
    "op13_filter_audit": op13,
}

ORACLES: dict[str, str] = {"op3_exact_top_k": OP3_SQL, "op5_line_dedup": OP5_SQL, "op10_substring_dedup": OP10_SQL, "op12_hard_negatives": OP12_SQL, "op13_filter_audit": OP13_SQL}
