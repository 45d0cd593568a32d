"""Registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from stockloom.llm import (
    bpe_tree,
    centroid_language,
    cuckoo_dedup,
    importance_quickselect,
    licence_scan,
    middle_cuts,
    quality_nbsvm,
    scaled_sketch,
    secret_crf,
    set_join,
    source_raking,
    threshold_topk,
    trie_counts,
)

QUERIES = {
    "op1_quality_nbsvm": quality_nbsvm.op1_quality_nbsvm,
    "op2_scaled_sketch": scaled_sketch.op2_scaled_sketch,
    "op3_secret_crf": secret_crf.op3_secret_crf,
    "op4_centroid_language": centroid_language.op4_centroid_language,
    "op5_trie_counts": trie_counts.op5_trie_counts,
    "op6_source_raking": source_raking.op6_source_raking,
    "op7_licence_scan": licence_scan.op7_licence_scan,
    "op8_bpe_tree": bpe_tree.op8_bpe_tree,
    "op9_set_join": set_join.op9_set_join,
    "op10_cuckoo_dedup": cuckoo_dedup.op10_cuckoo_dedup,
    "op11_middle_cuts": middle_cuts.op11_middle_cuts,
    "op12_importance_quickselect": importance_quickselect.op12_importance_quickselect,
    "op13_threshold_topk": threshold_topk.op13_threshold_topk,
}

ORACLE = {
    "op2_scaled_sketch": scaled_sketch.ORACLE,
    "op6_source_raking": source_raking.ORACLE,
    "op9_set_join": set_join.ORACLE,
    "op10_cuckoo_dedup": cuckoo_dedup.ORACLE,
    "op11_middle_cuts": middle_cuts.ORACLE,
    "op12_importance_quickselect": importance_quickselect.ORACLE,
    "op13_threshold_topk": threshold_topk.ORACLE,
}
