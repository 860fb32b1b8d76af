"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bin_packing, exact_dedup, jaccard_join, license_scan, quality_classifier, quality_rules, sentencepiece_codec, substring_dedup, suffix_dedup, warc_archive

QUERIES = {
    "op1_sentencepiece": sentencepiece_codec.query,
    "op2_license_scan": license_scan.query,
    "op3_jaccard_join": jaccard_join.query,
    "op4_warc": warc_archive.query,
    "op5_suffix_dedup": suffix_dedup.query,
    "op6_substring_dedup": substring_dedup.query,
    "op7_quality_classifier": quality_classifier.query,
    "op8_exact_dedup": exact_dedup.query,
    "op9_best_fit_packing": bin_packing.query,
    "op10_quality_rules": quality_rules.query,
}

ORACLES = {
    "op2_license_scan": license_scan.ORACLE,
    "op3_jaccard_join": jaccard_join.ORACLE,
    "op4_warc": warc_archive.ORACLE,
    "op5_suffix_dedup": suffix_dedup.ORACLE,
    "op6_substring_dedup": substring_dedup.ORACLE,
    "op8_exact_dedup": exact_dedup.ORACLE,
}
