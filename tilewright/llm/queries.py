"""Registered queries of this subpackage and their oracle SQL."""

from tilewright.llm import clusters, collisions, language, lm, mixing, neighbours, packing, quality, secrets, simhash, spelling, token_output, urls

QUERIES = {
    f.__name__: f for f in (
        lm.op1_lm_scores, language.op2_language_id, simhash.op3_simhash, token_output.op4_token_matrices,
        secrets.op5_secret_scan, quality.op6_quality_rules, mixing.op7_source_mix, urls.op8_url_filter,
        packing.op9_packing, neighbours.op10_nearest, collisions.op11_near_copies,
        clusters.op12_centroid_clusters, spelling.op13_spelling_variants)
}
ORACLES = {
    "op6_quality_rules": quality.SQL, "op11_near_copies": collisions.SQL, "op12_centroid_clusters": clusters.SQL}
