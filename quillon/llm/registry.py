"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import OP1_SQL, op1_chat
from .decontaminate import OP3_SQL, op3_decontamination
from .line_dedup import OP10_SQL, op10_line_dedup
from .ngram_join import OP2_SQL, op2_ngram_join
from .quality import op9_quality
from .secrets import op5_secrets
from .sharding import OP7_SQL, op7_sharding
from .tokens import op8_bpe
from .toxicity import op4_toxicity
from .webp import op6_webp


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat": op1_chat,
        "op2_ngram_join": op2_ngram_join,
        "op3_decontamination": op3_decontamination,
        "op4_toxicity": op4_toxicity,
        "op5_secrets": op5_secrets,
        "op6_webp": op6_webp,
        "op7_sharding": op7_sharding,
        "op8_bpe": op8_bpe,
        "op9_quality": op9_quality,
        "op10_line_dedup": op10_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat": OP1_SQL, "op2_ngram_join": OP2_SQL, "op3_decontamination": OP3_SQL, "op7_sharding": OP7_SQL, "op10_line_dedup": OP10_SQL}
