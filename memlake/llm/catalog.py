"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from memlake.llm import decontam, langid, lm, mixing, packing, quality, ranking, repair, secrets, simhash, substrings, urls, warc


def queries() -> dict:
    return {
        "op1_decontamination": decontam.query,
        "op2_quality_rules": quality.query,
        "op3_lm_score": lm.query,
        "op4_substring_dedup": substrings.query,
        "op5_secret_scan": secrets.query,
        "op6_simhash": simhash.query,
        "op7_language_id": langid.query,
        "op8_warc": warc.query,
        "op9_packing": packing.query,
        "op10_url_filter": urls.query,
        "op11_lexical_search": ranking.query,
        "op12_conversation_repair": repair.query,
        "op13_source_mixing": mixing.query,
    }


def oracle_sql() -> dict:
    return {
        "op1_decontamination": decontam.SQL, "op2_quality_rules": quality.SQL, "op4_substring_dedup": substrings.SQL, "op5_secret_scan": secrets.SQL, "op8_warc": warc.SQL,
        "op10_url_filter": urls.SQL, "op11_lexical_search": ranking.SQL, "op12_conversation_repair": repair.SQL, "op13_source_mixing": mixing.SQL,
    }
