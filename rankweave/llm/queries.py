"""The registered queries of this subpackage and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from rankweave.llm.alignment import op12_alignment
from rankweave.llm.centroids import OP11_SQL, op11_centroids
from rankweave.llm.decontaminate import OP10_SQL, op10_decontamination
from rankweave.llm.html_text import op7_html_text
from rankweave.llm.jaccard import op5_jaccard_join
from rankweave.llm.line_dedup import OP13_SQL, op13_line_dedup
from rankweave.llm.lm_score import op6_lm_score
from rankweave.llm.packing import op8_best_fit_packing
from rankweave.llm.quality import op9_quality
from rankweave.llm.suffix_dedup import op2_suffix_dedup
from rankweave.llm.token_counts import op4_token_counts
from rankweave.llm.url_filter import OP1_SQL, op1_url_filter
from rankweave.llm.vector_dedup import op3_vector_dedup

QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter,
        op2_suffix_dedup,
        op3_vector_dedup,
        op4_token_counts,
        op5_jaccard_join,
        op6_lm_score,
        op7_html_text,
        op8_best_fit_packing,
        op9_quality,
        op10_decontamination,
        op11_centroids,
        op12_alignment,
        op13_line_dedup,
    )
}
ORACLES: dict[str, str] = {"op1_url_filter": OP1_SQL, "op10_decontamination": OP10_SQL, "op11_centroids": OP11_SQL, "op13_line_dedup": OP13_SQL}
