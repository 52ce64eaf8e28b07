"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import op12_token_alignment
from .chat import OP4_SQL, op4_chat_formatting
from .html_extract import op1_html_extraction
from .line_dedup import op3_line_dedup
from .mixing import op10_mixing
from .nearest import op5_nearest
from .ngram_join import op8_ngram_jaccard
from .packing import op6_packing
from .pii import op7_personal_data
from .quality import OP9_SQL, op9_quality_rules
from .recurrent_lm import op11_recurrent_lm
from .substring_dedup import op2_suffix_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extraction": op1_html_extraction,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_line_dedup": op3_line_dedup,
        "op4_chat_formatting": op4_chat_formatting,
        "op5_nearest": op5_nearest,
        "op6_packing": op6_packing,
        "op7_personal_data": op7_personal_data,
        "op8_ngram_jaccard": op8_ngram_jaccard,
        "op9_quality_rules": op9_quality_rules,
        "op10_mixing": op10_mixing,
        "op11_recurrent_lm": op11_recurrent_lm,
        "op12_token_alignment": op12_token_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_formatting": OP4_SQL, "op9_quality_rules": OP9_SQL}
