"""Registered queries of the text operators, with their SQL where SQL can express them."""

from __future__ import annotations

from .decontaminate import OP13_SQL, op13_aho_corasick_decontamination
from .lines import op3_line_suffix_array
from .mixing import op8_subset_sum_mixing
from .negatives import OP12_SQL, op12_secondary_sort_negatives
from .pieces import op5_sentencepiece_backtracking
from .pii import op9_keyed_surrogates
from .quality import op1_distribution_divergence
from .secrets import op7_entropy_secrets
from .simhash import op6_simhash_bit_sliced
from .substring import op2_relative_lempel_ziv
from .tokencount import op10_overlap_resynchronisation
from .vectors import op4_subspace_pigeonhole
from .whitening import op11_incremental_whitening

QUERIES = {f.__name__: f for f in (
    op1_distribution_divergence, op2_relative_lempel_ziv, op3_line_suffix_array, op4_subspace_pigeonhole,
    op5_sentencepiece_backtracking, op6_simhash_bit_sliced,
    op7_entropy_secrets, op8_subset_sum_mixing, op9_keyed_surrogates,
    op10_overlap_resynchronisation, op11_incremental_whitening, op12_secondary_sort_negatives,
    op13_aho_corasick_decontamination,
)}
SQL: dict[str, str] = {
    "op12_secondary_sort_negatives": OP12_SQL,
    "op13_aho_corasick_decontamination": OP13_SQL,
}
