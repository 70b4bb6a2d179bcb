"""The queries of the training-data operators, with SQL for those that it can express."""

from corpusloom.llm import kmeans_tree, licenses, line_dedup, mixing, packing, quality, simhash, token_counts, toxicity, winnowing

QUERIES = {
    "op1_edit_token_counts": token_counts.op1_edit_token_counts,
    "op6_mixing": mixing.op6_mixing,
    "op10_license_digests": licenses.op10_license_digests,
    "op5_toxicity": toxicity.op5_toxicity,
    "op3_kmeans_tree": kmeans_tree.op3_kmeans_tree,
    "op4_quality": quality.op4_quality,
    "op2_winnowing": winnowing.op2_winnowing,
    "op7_pattern_packing": packing.op7_pattern_packing,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_simhash_near_dedup": simhash.op9_simhash_near_dedup,
}

ORACLES = {
    "op10_license_digests": licenses.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
}
