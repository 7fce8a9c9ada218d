"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from searchkit.llm import chat, decontaminate, language, mixing, quality, secrets, simhash, substring, toxicity, urls

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_url_filters": urls.op2_url_filters,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_mixing": mixing.op4_mixing,
    "op5_simhash": simhash.op5_simhash,
    "op6_secrets": secrets.op6_secrets,
    "op7_chat": chat.op7_chat,
    "op8_substring": substring.op8_substring,
    "op9_language": language.op9_language,
    "op10_quality_rules": quality.op10_quality_rules,
}

ORACLES = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op4_mixing": mixing.ORACLE,
    "op6_secrets": secrets.ORACLE,
    "op7_chat": chat.ORACLE,
    "op8_substring": substring.ORACLE,
    "op10_quality_rules": quality.ORACLE,
}
