"""The queries of this subpackage, for ``__spark_entry__``, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from studyloom.llm.decontamination import op6_positional_index
from studyloom.llm.language_id import op8_byte_gru
from studyloom.llm.line_dedup import op11_levelled_runs
from studyloom.llm.near_dedup import op3_signature_join
from studyloom.llm.oracles import oracle_sql
from studyloom.llm.overlaps import op12_overlap_relations
from studyloom.llm.packing import op2_best_fit_packing
from studyloom.llm.pii import op10_anchor_expansion
from studyloom.llm.quality import op5_adaptive_quality
from studyloom.llm.secrets import op4_ownership_frequency
from studyloom.llm.sharding import op9_lookup_sharding
from studyloom.llm.url_filter import op7_host_words
from studyloom.llm.warc import op1_warc_dictionary
from studyloom.llm.whitening import op13_exact_whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_warc_dictionary": op1_warc_dictionary,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_signature_join": op3_signature_join,
        "op4_ownership_frequency": op4_ownership_frequency,
        "op5_adaptive_quality": op5_adaptive_quality,
        "op6_positional_index": op6_positional_index,
        "op7_host_words": op7_host_words,
        "op8_byte_gru": op8_byte_gru,
        "op9_lookup_sharding": op9_lookup_sharding,
        "op10_anchor_expansion": op10_anchor_expansion,
        "op11_levelled_runs": op11_levelled_runs,
        "op12_overlap_relations": op12_overlap_relations,
        "op13_exact_whitening": op13_exact_whitening,
    }


__all__ = ["oracle_sql", "queries"]
