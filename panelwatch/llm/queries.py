"""The named queries of this package and their SQL twins."""

from __future__ import annotations

from panelwatch.llm import collocations, decontaminate, divergence, language, licenses, linededup, lmscore, neardup, packing, pages, secrets, topk, toxicity

QUERIES = {
    "op1_exact_top_k": topk.query,
    "op2_license_scan": licenses.query,
    "op3_line_dedup": linededup.query,
    "op4_best_fit_packing": packing.query,
    "op5_toxicity": toxicity.query,
    "op6_secret_scan": secrets.query,
    "op7_language_id": language.query,
    "op8_decontamination": decontaminate.query,
    "op9_near_duplicates": neardup.query,
    "op10_lm_scores": lmscore.query,
    "op11_source_divergence": divergence.query,
    "op12_main_text": pages.query,
    "op13_collocations": collocations.query,
}

ORACLE_SQL = {
    "op1_exact_top_k": topk.ORACLE_SQL,
    "op2_license_scan": licenses.ORACLE_SQL,
    "op3_line_dedup": linededup.ORACLE_SQL,
    "op11_source_divergence": divergence.ORACLE_SQL,
    "op13_collocations": collocations.ORACLE_SQL,
}
