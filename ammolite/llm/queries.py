"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from ammolite.llm.bin_packing import op10_bin_packing
from ammolite.llm.contamination import OP7_SQL, op7_contamination
from ammolite.llm.jaccard_join import OP8_SQL, op8_jaccard_join
from ammolite.llm.language_model import op3_language_model
from ammolite.llm.page_text import op4_page_text
from ammolite.llm.quality_rules import op9_quality_rules
from ammolite.llm.secret_scan import op1_secret_scan
from ammolite.llm.span_dedup import OP2_SQL, op2_span_dedup
from ammolite.llm.spelling_variants import op13_spelling_variants
from ammolite.llm.token_codes import op5_token_codes
from ammolite.llm.tokenizer_alignment import op11_tokenizer_alignment
from ammolite.llm.toxicity import op12_toxicity
from ammolite.llm.web_archive import OP6_SQL, op6_web_archive

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_span_dedup": op2_span_dedup,
    "op3_language_model": op3_language_model,
    "op4_page_text": op4_page_text,
    "op5_token_codes": op5_token_codes,
    "op6_web_archive": op6_web_archive,
    "op7_contamination": op7_contamination,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_quality_rules": op9_quality_rules,
    "op10_bin_packing": op10_bin_packing,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_toxicity": op12_toxicity,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL: dict[str, str] = {"op2_span_dedup": OP2_SQL, "op6_web_archive": OP6_SQL, "op7_contamination": OP7_SQL, "op8_jaccard_join": OP8_SQL}
