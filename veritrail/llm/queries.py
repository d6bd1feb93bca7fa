"""The queries opN_<name> and their SQL."""

from __future__ import annotations

from veritrail.llm import sql
from veritrail.llm.alignment import op13_alignment
from veritrail.llm.decontamination import op4_decontamination
from veritrail.llm.jaccard_join import op8_jaccard_join
from veritrail.llm.language_id import op2_language_id
from veritrail.llm.mixing import op7_mixing
from veritrail.llm.packing import op12_packing
from veritrail.llm.periodic_runs import op11_periodic_runs
from veritrail.llm.quality import op6_quality_rules
from veritrail.llm.sharding import op1_sharding
from veritrail.llm.substring_dedup import op10_substring_dedup
from veritrail.llm.suffix_dedup import op5_suffix_dedup
from veritrail.llm.token_output import op3_token_output
from veritrail.llm.warc import op9_warc


def queries() -> dict:
    return {
        "op1_sharding": op1_sharding,
        "op2_language_id": op2_language_id,
        "op3_token_output": op3_token_output,
        "op4_decontamination": op4_decontamination,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_quality_rules": op6_quality_rules,
        "op7_mixing": op7_mixing,
        "op8_jaccard_join": op8_jaccard_join,
        "op9_warc": op9_warc,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_packing": op12_packing,
        "op13_alignment": op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_suffix_dedup": sql.OP5,
        "op6_quality_rules": sql.OP6,
        "op8_jaccard_join": sql.OP8,
        "op9_warc": sql.OP9,
        "op10_substring_dedup": sql.OP10,
        "op11_periodic_runs": sql.OP11,
    }
