"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tessera.llm import ann, byte_bpe, centroids, dac, decontaminate, language_model, line_dedup, packing, quality, simhash, spelling, token_counts, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        ann.op1_ann,
        decontaminate.op2_decontaminate,
        simhash.op3_simhash,
        quality.op4_quality,
        language_model.op5_language_model,
        line_dedup.op6_line_dedup,
        token_counts.op7_token_counts,
        packing.op8_packing,
        toxicity.op9_toxicity,
        dac.op10_token_file,
        centroids.op11_centroids,
        byte_bpe.op12_byte_bpe,
        spelling.op13_spelling,
    )
}

ORACLE = {"op6_line_dedup": line_dedup.OP6_SQL}
