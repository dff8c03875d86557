"""Registered queries of this package and their SQL counterparts."""

from __future__ import annotations

from .bpe import op4_bpe_round_trip
from .exact_dedup import OP1_SQL, op1_exact_dedup
from .jaccard_join import op5_jaccard_join
from .language import op3_language_id
from .line_dedup import op9_line_dedup
from .mixing import op8_source_mix
from .periodic import op11_periodic_runs
from .personal import op13_personal_data
from .quality import op10_quality_rules
from .secrets import op2_secret_scan
from .suffix_tree import op6_lm_score
from .warc import OP7_SQL, op7_warc_round_trip
from .whitening import op12_embedding_whitening

QUERIES = {f.__name__: f for f in (
    op1_exact_dedup, op2_secret_scan, op3_language_id, op4_bpe_round_trip, op5_jaccard_join, op6_lm_score, op7_warc_round_trip,
    op8_source_mix, op9_line_dedup, op10_quality_rules, op11_periodic_runs, op12_embedding_whitening, op13_personal_data)}
ORACLE = {"op1_exact_dedup": OP1_SQL, "op7_warc_round_trip": OP7_SQL}
