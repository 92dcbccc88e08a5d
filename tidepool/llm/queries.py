"""The subpackage's queries and their oracle SQL, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from . import bpe, fingerprint, jaccard, leaks, licenses, media, middle, mixing, passages, quality, secrets, sharding, vectors

QUERIES = {
    "op1_license_scans": licenses.op1_license_scans,
    "op2_substring_dedup": passages.op2_substring_dedup,
    "op3_jaccard": jaccard.op3_jaccard,
    "op4_sharding": sharding.op4_sharding,
    "op5_quality": quality.op5_quality,
    "op6_bpe": bpe.op6_bpe,
    "op7_fingerprints": fingerprint.op7_fingerprints,
    "op8_mixing": mixing.op8_mixing,
    "op9_secrets": secrets.op9_secrets,
    "op10_media": media.op10_media,
    "op11_middle": middle.op11_middle,
    "op12_leaks": leaks.op12_leaks,
    "op13_vector_codes": vectors.op13_vector_codes,
}
ORACLES = {
    "op1_license_scans": licenses.ORACLE,
    "op2_substring_dedup": passages.ORACLE,
    "op3_jaccard": jaccard.ORACLE,
    "op4_sharding": sharding.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op11_middle": middle.ORACLE,
    "op12_leaks": leaks.ORACLE,
    "op13_vector_codes": vectors.ORACLE,
}
