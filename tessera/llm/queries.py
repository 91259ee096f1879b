"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import audit, bpe, importance, licenses, lines, mixing, pii, quality, simhash, suffixes, topk, vectors, warc

QUERIES = {
    "op1_suffix_dedup": suffixes.op1_suffix_dedup,
    "op2_pii": pii.op2_pii,
    "op3_warc": warc.op3_warc,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_bpe": bpe.op5_bpe,
    "op6_simhash_near_dedup": simhash.op6_simhash_near_dedup,
    "op7_exact_top_k": topk.op7_exact_top_k,
    "op8_line_dedup": lines.op8_line_dedup,
    "op9_source_mixing": mixing.op9_source_mixing,
    "op10_license_scan": licenses.op10_license_scan,
    "op11_embedding_near_dedup": vectors.op11_embedding_near_dedup,
    "op12_filter_audit": audit.op12_filter_audit,
    "op13_importance_resampling": importance.op13_importance_resampling,
}
SQL = {
    "op3_warc": warc.SQL,
    "op4_quality_rules": quality.SQL,
    "op7_exact_top_k": topk.SQL,
    "op8_line_dedup": lines.SQL,
    "op10_license_scan": licenses.SQL,
    "op11_embedding_near_dedup": vectors.SQL,
    "op12_filter_audit": audit.SQL,
    "op13_importance_resampling": importance.SQL,
}
