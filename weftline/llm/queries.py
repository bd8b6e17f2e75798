"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .align import op13_alignment
from .ann import op6_ann
from .bpe import op10_bpe
from .decontaminate import op4_decontaminate
from .divergence import ORACLE as DIVERGENCE_SQL
from .divergence import op11_divergence
from .language import op7_language
from .licenses import ORACLE as LICENSES_SQL
from .licenses import op5_licenses
from .lm import op3_lm
from .quality import op2_quality
from .rules import op12_rules
from .simhash import op8_simhash
from .tokencount import op9_token_counts
from .toxicity import op1_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality": op2_quality,
    "op3_lm": op3_lm,
    "op4_decontaminate": op4_decontaminate,
    "op5_licenses": op5_licenses,
    "op6_ann": op6_ann,
    "op7_language": op7_language,
    "op8_simhash": op8_simhash,
    "op9_token_counts": op9_token_counts,
    "op10_bpe": op10_bpe,
    "op11_divergence": op11_divergence,
    "op12_rules": op12_rules,
    "op13_alignment": op13_alignment,
}

ORACLES: dict[str, str] = {"op5_licenses": LICENSES_SQL, "op11_divergence": DIVERGENCE_SQL}
