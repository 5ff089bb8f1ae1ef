"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from kinweave.llm import bpe, decontaminate, kneser_ney, lexical, near_dup, ogg, pii, ppm, repeats, sharding, spelling, token_counts, url_filter
from kinweave.llm.common import Query


def queries() -> dict[str, Query]:
    return {
        "op1_byte_bpe": bpe.op1_byte_bpe,
        "op2_kneser_ney_quality": kneser_ney.op2_kneser_ney_quality,
        "op3_feistel_sharding": sharding.op3_feistel_sharding,
        "op4_contextual_pii": pii.op4_contextual_pii,
        "op5_pigeonhole_decontamination": decontaminate.op5_pigeonhole_decontamination,
        "op6_url_filter": url_filter.op6_url_filter,
        "op7_token_counts": token_counts.op7_token_counts,
        "op8_setsketch_near_dup": near_dup.op8_setsketch_near_dup,
        "op9_suffix_array_dedup": repeats.op9_suffix_array_dedup,
        "op10_ogg_media": ogg.op10_ogg_media,
        "op11_ppm_scores": ppm.op11_ppm_scores,
        "op12_lexical_search": lexical.op12_lexical_search,
        "op13_spelling_variants": spelling.op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    """The others (permutations, models, tokenizers, containers, CRCs) are no SQL; tests hold them against brute force."""
    return {"op8_setsketch_near_dup": near_dup.OP8_SQL, "op9_suffix_array_dedup": repeats.OP9_SQL, "op12_lexical_search": lexical.OP12_SQL}
