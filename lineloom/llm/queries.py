"""Registered queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from lineloom.llm.codec import op4_sentencepiece
from lineloom.llm.exact_dedup import OP3_SQL, op3_exact_dedup
from lineloom.llm.filter_audit import OP11_SQL, op11_filter_audit
from lineloom.llm.jaccard_join import op2_jaccard_join
from lineloom.llm.langid import op9_language_id
from lineloom.llm.license_scan import op1_license_scan
from lineloom.llm.line_dedup import op10_line_dedup
from lineloom.llm.lm_score import op5_lm_scoring
from lineloom.llm.mixing import op7_mixing
from lineloom.llm.packing import op12_best_fit_packing
from lineloom.llm.periodic import op13_periodic_runs
from lineloom.llm.quality import op8_quality
from lineloom.llm.token_counts import op6_token_counts

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_token_counts": op6_token_counts,
    "op7_mixing": op7_mixing,
    "op8_quality": op8_quality,
    "op9_language_id": op9_language_id,
    "op10_line_dedup": op10_line_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES = {"op3_exact_dedup": OP3_SQL, "op11_filter_audit": OP11_SQL}
