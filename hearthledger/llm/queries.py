"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import (
    byte_bpe, clustering, decontamination, html_extraction, jaccard_join, language_id, mixing, quality_classifier, quality_rules,
    sharding, token_counts, url_filters, whitening,
)

QUERIES = {
    f.__name__: f
    for f in (
        language_id.op1_language_id,
        quality_classifier.op2_quality_classifier,
        decontamination.op3_decontamination,
        url_filters.op4_url_filters,
        sharding.op5_sharding,
        byte_bpe.op6_byte_bpe,
        token_counts.op7_token_counts,
        html_extraction.op8_html_extraction,
        jaccard_join.op9_jaccard_join,
        quality_rules.op10_quality_rules,
        whitening.op11_embedding_whitening,
        clustering.op12_centroid_clustering,
        mixing.op13_source_mixing,
    )
}

SQL = {
    "op3_decontamination": decontamination.OP3_SQL,
    "op4_url_filters": url_filters.OP4_SQL,
    "op9_jaccard_join": jaccard_join.OP9_SQL,
    "op12_centroid_clustering": clustering.OP12_SQL,
    "op13_source_mixing": mixing.OP13_SQL,
}
