"""Queries of this subpackage and their SQL twins."""

from __future__ import annotations

import corpus_pipeline
from lumenfold.llm import op01_pii, op02_language, op03_secrets, op04_mixing, op05_neardup, op06_decontamination, op07_pages, op08_topk, op09_toxicity, op10_urls, op11_centroids, op12_quality, op13_ranked

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op2_language": op02_language.op2_language,
    "op1_pii": op01_pii.op1_pii,
    "op3_secrets": op03_secrets.op3_secrets,
    "op4_mixing": op04_mixing.op4_mixing,
    "op5_neardup": op05_neardup.op5_neardup,
    "op6_decontamination": op06_decontamination.op6_decontamination,
    "op7_main_text": op07_pages.op7_main_text,
    "op8_topk": op08_topk.op8_topk,
    "op9_toxicity": op09_toxicity.op9_toxicity,
    "op10_url_rules": op10_urls.op10_url_rules,
    "op11_centroids": op11_centroids.op11_centroids,
    "op12_quality": op12_quality.op12_quality,
    "op13_ranked": op13_ranked.op13_ranked,
}

ORACLES = {
    "op4_mixing": op04_mixing.ORACLE,
    "op8_topk": op08_topk.ORACLE,
    "op10_url_rules": op10_urls.ORACLE,
    "op11_centroids": op11_centroids.ORACLE,
    "op12_quality": op12_quality.ORACLE,
    "op13_ranked": op13_ranked.ORACLE,
}
