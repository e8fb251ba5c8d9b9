"""The llm operators' queries and oracle SQL."""

from __future__ import annotations

from siteward.llm import license_scans, quality_rules
from siteward.llm.chat_formatting import op3_chat_formatting
from siteward.llm.decontamination import op10_decontamination
from siteward.llm.hard_negatives import op12_hard_negatives
from siteward.llm.html_extraction import op8_html_extraction
from siteward.llm.license_scans import op7_license_scans
from siteward.llm.quality_classifier import op13_quality_classifier
from siteward.llm.quality_rules import op4_quality_rules
from siteward.llm.sentencepiece_stream import op9_sentencepiece
from siteward.llm.sharding import op2_sharding
from siteward.llm.simhash import op6_simhash_neardup
from siteward.llm.token_alignment import op11_token_alignment
from siteward.llm.token_counts import op1_token_counts
from siteward.llm.toxicity import op5_toxicity

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_sharding": op2_sharding,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_quality_rules": op4_quality_rules,
    "op5_toxicity": op5_toxicity,
    "op6_simhash_neardup": op6_simhash_neardup,
    "op7_license_scans": op7_license_scans,
    "op8_html_extraction": op8_html_extraction,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_decontamination": op10_decontamination,
    "op11_token_alignment": op11_token_alignment,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_quality_classifier": op13_quality_classifier,
}
ORACLES: dict[str, str] = {"op4_quality_rules": quality_rules.ORACLE_SQL, "op7_license_scans": license_scans.ORACLE_SQL}
