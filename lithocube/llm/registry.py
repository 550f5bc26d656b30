"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, importance, media, mixing, ngram_join, packing, quality_classifier, quality_rules, sentencepiece_codec, sharding, spelling, suffix_dedup, token_counts
from .oracles import ORACLES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        suffix_dedup.op1_suffix_array_dedup,
        sharding.op2_rendezvous_sharding,
        ngram_join.op3_ngram_jaccard_join,
        sentencepiece_codec.op4_sentencepiece,
        mixing.op5_systematic_mixing,
        chat.op6_chat_formatting,
        token_counts.op7_token_counts,
        media.op8_media_tiff,
        quality_classifier.op9_quality_classifier,
        quality_rules.op10_quality_rules,
        importance.op11_importance_resampling,
        packing.op12_packing,
        spelling.op13_spelling_variants,
    ]
    import corpus_pipeline

    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
