"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from quillstone.llm import align, bpe, exact_dedup, neighbours, packing, pieces, quality, simhash, substrings, token_shards, url_filter, warc, whitening

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_best_fit_packing": packing.op1_best_fit_packing,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_url_filter": url_filter.op3_url_filter,
        "op4_token_shards": token_shards.op4_token_shards,
        "op5_nearest_neighbours": neighbours.op5_nearest_neighbours,
        "op6_quality": quality.op6_quality,
        "op7_warc_fixity": warc.op7_warc_fixity,
        "op8_byte_bpe": bpe.op8_byte_bpe,
        "op9_substring_dedup": substrings.op9_substring_dedup,
        "op10_simhash": simhash.op10_simhash,
        "op11_cross_tokenizer": align.op11_cross_tokenizer,
        "op12_whitening": whitening.op12_whitening,
        "op13_sentencepiece": pieces.op13_sentencepiece,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": exact_dedup.OP2_SQL,
        "op3_url_filter": url_filter.op3_sql(),
        "op5_nearest_neighbours": neighbours.OP5_SQL,
        "op7_warc_fixity": warc.OP7_SQL,
    }
