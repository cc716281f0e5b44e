"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framelake.llm import bpe, chat, fingerprints, jaccard, mixing, neighbours, ngrams, secrets, suffixes, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": secrets.op1_secrets,
    "op2_suffixes": suffixes.op2_suffixes,
    "op3_fingerprints": fingerprints.op3_fingerprints,
    "op4_mixing": mixing.op4_mixing,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_ngrams": ngrams.op6_ngrams,
    "op7_chat": chat.op7_chat,
    "op8_jaccard": jaccard.op8_jaccard,
    "op9_neighbours": neighbours.op9_neighbours,
    "op10_bpe": bpe.op10_bpe,
}
ORACLE_SQL: dict[str, str] = {"op2_suffixes": suffixes.OP2_SQL, "op7_chat": chat.OP7_SQL, "op8_jaccard": jaccard.OP8_SQL, "op9_neighbours": neighbours.OP9_SQL}
