"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from rangewise.llm import oracles
from rangewise.llm.decontaminate import op7_decontaminate
from rangewise.llm.language_id import op9_language_id
from rangewise.llm.license_scan import op10_license_scan
from rangewise.llm.mixing import op2_mixing
from rangewise.llm.quality_rules import op1_quality_rules
from rangewise.llm.secret_scan import op3_secret_scan
from rangewise.llm.simhash import op4_simhash
from rangewise.llm.substring_dedup import op5_substring_dedup
from rangewise.llm.token_counts import op8_token_counts
from rangewise.llm.toxicity import op6_toxicity


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality_rules, op2_mixing, op3_secret_scan, op4_simhash, op5_substring_dedup, op6_toxicity, op7_decontaminate, op8_token_counts, op9_language_id, op10_license_scan)}


def oracle_sql() -> dict[str, str]:
    return {"op5_substring_dedup": oracles.OP5, "op7_decontaminate": oracles.OP7, "op10_license_scan": oracles.OP10}
