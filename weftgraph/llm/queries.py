"""The queries of this subpackage and their SQL."""

from . import bpe_codec, exact_dedup, html_text, mixing, quality_classifier, quality_rules, simhash, substring_dedup, suffix_dedup, token_counts

QUERIES = {
    "op1_simhash": simhash.query,
    "op2_exact_dedup": exact_dedup.query,
    "op3_quality_rules": quality_rules.query,
    "op4_suffix_dedup": suffix_dedup.query,
    "op5_bpe_codec": bpe_codec.query,
    "op6_quality_classifier": quality_classifier.query,
    "op7_token_counts": token_counts.query,
    "op8_mixing": mixing.query,
    "op9_html_text": html_text.query,
    "op10_substring_dedup": substring_dedup.query,
}

ORACLE_SQL = {"op2_exact_dedup": exact_dedup.ORACLE_SQL, "op8_mixing": mixing.ORACLE_SQL, "op10_substring_dedup": substring_dedup.ORACLE_SQL}
