"""The registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from siltstone.llm.bpe import op9
from siltstone.llm.jaccard import op1
from siltstone.llm.lines import op5
from siltstone.llm.lm import op6
from siltstone.llm.mixing import op3
from siltstone.llm.passages import op7
from siltstone.llm.pii import op8
from siltstone.llm.quality import op2
from siltstone.llm.substrings import op10
from siltstone.llm.topk import op4

QUERIES = {
    "op1_ngram_jaccard": op1,
    "op2_quality_rules": op2,
    "op3_source_mixing": op3,
    "op4_exact_top_k": op4,
    "op5_line_dedup": op5,
    "op6_lm_score": op6,
    "op7_substring_dedup": op7,
    "op8_personal_data": op8,
    "op9_byte_bpe": op9,
    "op10_suffix_dedup": op10,
}
