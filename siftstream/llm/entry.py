"""Queries of the corpus operators, and SQL where it can express them."""

from __future__ import annotations

from . import avi, bpe, linededup, neardup, packing, pages, quality, resampling, spelling, token_files, toxicity, warc, winnowing


def queries() -> dict:
    return {
        "op1_warc_bundles": warc.query,
        "op10_bayes_jaccard_join": neardup.query,
        "op11_noisy_or_toxicity": toxicity.query,
        "op12_importance_resampling": resampling.query,
        "op13_spelling_variants": spelling.query,
        "op2_rans_token_files": token_files.query,
        "op3_site_templates": pages.query,
        "op4_line_templates": linededup.query,
        "op5_kneser_ney_quality": quality.query,
        "op6_first_fit_packing": packing.query,
        "op7_winnowing": winnowing.query,
        "op8_forced_boundary_bpe": bpe.query,
        "op9_avi_motion_jpeg": avi.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_bundles": warc.ORACLE}
