"""The queries of the training-data operators, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recallforge.llm import decontam, edit_count, graph_ann, langid, license_scan, ngram_join, packing, piece_codec, prefix_trie, secret_scan, token_store, url_filter, whitening

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_ngram_join": ngram_join.op1_ngram_join,
        "op2_license_scan": license_scan.op2_license_scan,
        "op3_token_store": token_store.op3_token_store,
        "op4_url_filter": url_filter.op4_url_filter,
        "op5_graph_ann": graph_ann.op5_graph_ann,
        "op6_edit_counts": edit_count.op6_edit_counts,
        "op7_decontamination": decontam.op7_decontamination,
        "op8_secret_scan": secret_scan.op8_secret_scan,
        "op9_packing": packing.op9_packing,
        "op10_language_id": langid.op10_language_id,
        "op11_piece_codec": piece_codec.op11_piece_codec,
        "op12_whitening": whitening.op12_whitening,
        "op13_prefix_trie": prefix_trie.op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_license_scan": license_scan.SQL,
        "op7_decontamination": decontam.SQL,
        "op8_secret_scan": secret_scan.SQL,
    }
