"""The queries over the training-data operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.bpe import op10_bpe
from lodestone.llm.chat import op2_chat_masks
from lodestone.llm.chunk_store import op5_chunk_store
from lodestone.llm.iso_media import op4_iso_media
from lodestone.llm.licenses import op8_licenses
from lodestone.llm.mixing import op7_mixing
from lodestone.llm.near_dup import op3_near_duplicates
from lodestone.llm.outliers import op1_outliers
from lodestone.llm.secrets import op9_secrets
from lodestone.llm.toxicity import op6_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op8_licenses": op8_licenses, "op3_near_duplicates": op3_near_duplicates, "op6_toxicity": op6_toxicity, "op1_outliers": op1_outliers, "op2_chat_masks": op2_chat_masks, "op9_secrets": op9_secrets, "op4_iso_media": op4_iso_media, "op7_mixing": op7_mixing, "op5_chunk_store": op5_chunk_store, "op10_bpe": op10_bpe}


def oracle_sql() -> dict[str, str]:
    return {}
