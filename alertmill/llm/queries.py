"""The queries of this subpackage, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from alertmill.llm.decontaminate import OP6_SQL, op6_decontamination
from alertmill.llm.fingerprints import op1_fingerprints
from alertmill.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from alertmill.llm.html_extract import op12_html_extraction
from alertmill.llm.line_dedup import op5_line_dedup
from alertmill.llm.mixing import op4_mixing
from alertmill.llm.near_duplicates import OP7_SQL, op7_jaccard_join
from alertmill.llm.quality import op8_quality
from alertmill.llm.substring_dedup import OP9_SQL, op9_substring_dedup
from alertmill.llm.suffix_index import op10_suffix_dedup
from alertmill.llm.toxicity import op3_toxicity
from alertmill.llm.warc import op2_warc
from alertmill.llm.whitening import op13_whitening

QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_warc": op2_warc,
    "op3_toxicity": op3_toxicity,
    "op4_mixing": op4_mixing,
    "op5_line_dedup": op5_line_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_quality": op8_quality,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_html_extraction": op12_html_extraction,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {"op6_decontamination": OP6_SQL, "op7_jaccard_join": OP7_SQL, "op9_substring_dedup": OP9_SQL, "op11_hard_negatives": OP11_SQL}
