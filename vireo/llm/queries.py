"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import align, bpe, decontaminate, jaccard, lines, lm, neighbours, quality, repair, sharding, toxicity, warc, wavelet

QUERIES = {
    "op1_warc_normaliser": warc.op1_warc_normaliser,
    "op2_hash_tree": sharding.op2_hash_tree,
    "op3_wavelet_matrix": wavelet.op3_wavelet_matrix,
    "op4_subword_lattice": lm.op4_subword_lattice,
    "op5_jaccard_join": jaccard.op5_jaccard_join,
    "op6_duckdb_bpe": bpe.op6_duckdb_bpe,
    "op7_rule_ledger": quality.op7_rule_ledger,
    "op8_cgk_decontamination": decontaminate.op8_cgk_decontamination,
    "op9_line_dedup": lines.op9_line_dedup,
    "op10_weak_supervision": toxicity.op10_weak_supervision,
    "op11_rank_convergence": repair.op11_rank_convergence,
    "op12_dimension_scan": neighbours.op12_dimension_scan,
    "op13_fragment_alignment": align.op13_fragment_alignment,
}

ORACLES = {
    "op1_warc_normaliser": warc.OP1_SQL,
    "op2_hash_tree": sharding.OP2_SQL,
    "op5_jaccard_join": jaccard.OP5_SQL,
    "op7_rule_ledger": quality.OP7_SQL,
    "op9_line_dedup": lines.OP9_SQL,
    "op11_rank_convergence": repair.OP11_SQL,
    "op12_dimension_scan": neighbours.OP12_SQL,
}
