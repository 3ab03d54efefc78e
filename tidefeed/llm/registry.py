"""Queries and SQL of this subpackage."""

from .decontaminate import op9_decontamination
from .doubling import ORACLE_OP11, op11_substring_dedup
from .exact_dedup import ORACLE_OP2, op2_exact_dedup
from .mixing import op8_mixing
from .pitman_yor import op1_pitman_yor
from .quality import op6_quality
from .secrets import op5_secret_scan
from .simhash import op4_simhash
from .suffix_dedup import op10_suffix_dedup
from .tokens import op7_token_counts
from .toxicity import op3_toxicity
from .vector_codes import ORACLE_OP13, op13_vector_codes
from .whitening import op12_whitening

QUERIES = {
    "op1_pitman_yor": op1_pitman_yor,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_simhash": op4_simhash,
    "op5_secret_scan": op5_secret_scan,
    "op6_quality": op6_quality,
    "op7_token_counts": op7_token_counts,
    "op8_mixing": op8_mixing,
    "op9_decontamination": op9_decontamination,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_whitening": op12_whitening,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE = {"op2_exact_dedup": ORACLE_OP2, "op11_substring_dedup": ORACLE_OP11, "op13_vector_codes": ORACLE_OP13}
