"""The queries of this subpackage, for __spark_entry__.py."""

from __future__ import annotations

from . import divergence, jaccard, lines, media, packing, pieces, quality, search, secrets, substrings, suffixes, tokens, toxicity


def queries() -> dict:
    return {
        "op1_substring_dedup": substrings.op1_substring_dedup,
        "op2_media": media.op2_media,
        "op3_suffix_dedup": suffixes.op3_suffix_dedup,
        "op4_quality_rules": quality.op4_quality_rules,
        "op5_line_dedup": lines.op5_line_dedup,
        "op6_packing": packing.op6_packing,
        "op7_sentencepiece": pieces.op7_sentencepiece,
        "op8_secret_scans": secrets.op8_secret_scans,
        "op9_jaccard_join": jaccard.op9_jaccard_join,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_token_codes": tokens.op11_token_codes,
        "op12_source_divergence": divergence.op12_source_divergence,
        "op13_ranked_search": search.op13_ranked_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": lines.OP5_SQL, "op12_source_divergence": divergence.OP12_SQL, "op13_ranked_search": search.OP13_SQL}
