"""The subpackage's queries, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from quillstone.llm.decontaminate import op8_decontamination
from quillstone.llm.language_id import op2_language_id
from quillstone.llm.license_scan import op3_license_scan
from quillstone.llm.line_dedup import op10_line_dedup
from quillstone.llm.lm_mixing import op7_lm_scoring
from quillstone.llm.packing import op9_packing
from quillstone.llm.quality_qda import op5_quality_classifier
from quillstone.llm.quality_rules import op1_quality_rules
from quillstone.llm.sharding import op6_sharding
from quillstone.llm.simhash import op4_simhash

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_language_id": op2_language_id,
    "op3_license_scan": op3_license_scan,
    "op4_simhash": op4_simhash,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_sharding": op6_sharding,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_decontamination": op8_decontamination,
    "op9_packing": op9_packing,
    "op10_line_dedup": op10_line_dedup,
}

#: Learned models, 64-bit hashes of shingles, tokenizers and iterative packing are beyond SQL; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {}
