"""Queries of the corpus operations, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from gradewell.llm.chat_format import op2_chat_format
from gradewell.llm.conversation_repair import op11_conversation_repair
from gradewell.llm.decontaminate import op6_decontaminate
from gradewell.llm.license_scan import op10_license_scan
from gradewell.llm.lm_scoring import op1_lm_score
from gradewell.llm.minhash import op7_minhash_dedup
from gradewell.llm.oracles import SQL
from gradewell.llm.packing import op9_packing
from gradewell.llm.quality_rules import op5_quality_rules
from gradewell.llm.secret_scan import op12_secret_scan
from gradewell.llm.suffix_dedup import op8_suffix_dedup
from gradewell.llm.token_counts import op4_token_counts
from gradewell.llm.warc import op3_warc
from gradewell.llm.whitening import op13_whitening

QUERIES = {
    "op1_lm_score": op1_lm_score,
    "op2_chat_format": op2_chat_format,
    "op3_warc": op3_warc,
    "op4_token_counts": op4_token_counts,
    "op5_quality_rules": op5_quality_rules,
    "op6_decontaminate": op6_decontaminate,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_packing": op9_packing,
    "op10_license_scan": op10_license_scan,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_secret_scan": op12_secret_scan,
    "op13_whitening": op13_whitening,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {name: sql.strip() for name, sql in SQL.items()}
