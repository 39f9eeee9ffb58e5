"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from colloquy.llm import decontam, extraction, langid, packing, pii, quality, rules, simhash, tokencount, warc


def queries() -> dict:
    import corpus_pipeline

    return {
        "pipeline": corpus_pipeline.run,
        "op1_quality": quality.op1_quality,
        "op2_packing": packing.op2_packing,
        "op3_warc": warc.op3_warc,
        "op4_main_text": extraction.op4_main_text,
        "op5_langid": langid.op5_langid,
        "op6_rules": rules.op6_rules,
        "op7_token_counts": tokencount.op7_token_counts,
        "op8_pii": pii.op8_pii,
        "op9_decontamination": decontam.op9_decontamination,
        "op10_simhash": simhash.op10_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": warc.SQL, "op6_rules": rules.SQL, "op9_decontamination": decontam.SQL}
