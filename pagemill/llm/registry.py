"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm.alignment import op11_token_alignment
from pagemill.llm.byte_bpe import op8_byte_bpe
from pagemill.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from pagemill.llm.html_text import op4_html_extraction
from pagemill.llm.language_id import op7_language_id
from pagemill.llm.line_dedup import OP2_SQL, op2_line_dedup
from pagemill.llm.packing import op6_best_fit_packing
from pagemill.llm.simhash import op10_simhash_near_dedup
from pagemill.llm.token_counts import op3_token_counts
from pagemill.llm.toxicity import op9_toxicity
from pagemill.llm.vector_codes import OP13_SQL, op13_vector_codes
from pagemill.llm.vector_dedup import OP5_SQL, op5_embedding_near_dedup
from pagemill.llm.window_packing import op12_window_packing


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_line_dedup": op2_line_dedup,
        "op3_token_counts": op3_token_counts,
        "op4_html_extraction": op4_html_extraction,
        "op5_embedding_near_dedup": op5_embedding_near_dedup,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_language_id": op7_language_id,
        "op8_byte_bpe": op8_byte_bpe,
        "op9_toxicity": op9_toxicity,
        "op10_simhash_near_dedup": op10_simhash_near_dedup,
        "op11_token_alignment": op11_token_alignment,
        "op12_window_packing": op12_window_packing,
        "op13_vector_codes": op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op2_line_dedup": OP2_SQL, "op5_embedding_near_dedup": OP5_SQL, "op13_vector_codes": OP13_SQL}
