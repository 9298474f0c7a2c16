"""Queries of this folder and their SQL twins."""

from __future__ import annotations

import corpus_pipeline

from . import (
    anomalies, boilerplate, clusters, decontaminate, fingerprints, mixing, neardup, packing, paragraphs, quality, resampling,
    tokens, urls,
)

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_token_counts": tokens.query,
    "op2_mix_sources": mixing.query,
    "op3_quality_classifier": quality.query,
    "op4_line_dedup": boilerplate.query,
    "op5_pack_tokens": packing.query,
    "op6_near_duplicates": neardup.query,
    "op7_repeated_paragraphs": paragraphs.query,
    "op8_url_filter": urls.query,
    "op9_decontaminate": decontaminate.query,
    "op10_fingerprints": fingerprints.query,
    "op11_quality_rules": anomalies.query,
    "op12_resample": resampling.query,
    "op13_clusters": clusters.query,
}
ORACLES = {
    "op2_mix_sources": mixing.ORACLE,
    "op4_line_dedup": boilerplate.ORACLE,
    "op6_near_duplicates": neardup.ORACLE,
    "op12_resample": resampling.ORACLE,
    "op13_clusters": clusters.ORACLE,
}
