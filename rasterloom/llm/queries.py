"""Queries of the training-data operators, and SQL where it can express them; tests/llm hold the others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm import ann, credentials, hilbert, jaccard, mixing, packing, pii, suffix, toxicity, winnow
from rasterloom.llm.oracles import ORACLE_SQL as ORACLE_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": suffix.op1,
    "op2_nearest_neighbours": ann.op2,
    "op3_toxicity": toxicity.op3,
    "op4_jaccard_join": jaccard.op4,
    "op5_mixing": mixing.op5,
    "op6_packing": packing.op6,
    "op7_fingerprints": winnow.op7,
    "op8_secrets": credentials.op8,
    "op9_personal_data": pii.op9,
    "op10_sharding": hilbert.op10,
}
