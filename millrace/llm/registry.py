"""Queries and oracle SQL of this folder."""

from __future__ import annotations

from . import alignment, bytebpe, counts, exact, language, minhash, nearjoin, packing, quality, suffix, tokenfile, variants, warc

QUERIES = {
    "op1_exact_dedup": exact.op1_exact_dedup,
    "op2_suffix_dedup": suffix.op2_suffix_dedup,
    "op3_token_counts": counts.op3_token_counts,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_warc": warc.op5_warc,
    "op6_near_join": nearjoin.op6_near_join,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_byte_bpe": bytebpe.op8_byte_bpe,
    "op9_language_id": language.op9_language_id,
    "op10_token_file": tokenfile.op10_token_file,
    "op11_alignment": alignment.op11_alignment,
    "op12_minhash": minhash.op12_minhash,
    "op13_variants": variants.op13_variants,
}
SQL = {
    "op1_exact_dedup": exact.OP1_SQL,
    "op2_suffix_dedup": suffix.OP2_SQL,
    "op5_warc": warc.OP5_SQL,
    "op6_near_join": nearjoin.OP6_SQL,
    "op12_minhash": minhash.OP12_SQL,
    "op13_variants": variants.OP13_SQL,
}
