"""The queries of this subpackage, and their SQL where SQL can express them; the pipeline is in corpus_pipeline.py."""

from __future__ import annotations

from llm import bpe, chat, collocations, exact, licenses, lines, minhash, mixing, pitman_yor, quality, secrets, spelling, toxicity


def queries():
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_secret_scan": secrets.op2_secrets,
        "op3_quality_rules": quality.op3_quality,
        "op4_bpe": bpe.op4_bpe,
        "op5_exact_dedup": exact.op5_exact_dedup,
        "op6_lm_score": pitman_yor.op6_lm_score,
        "op7_line_dedup": lines.op7_line_dedup,
        "op8_chat_formatting": chat.op8_chat,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_minhash_near_dedup": minhash.op10_near_duplicates,
        "op11_collocations": collocations.op11_collocations,
        "op12_spelling_variants": spelling.op12_spelling,
        "op13_license_scan": licenses.op13_licenses,
    }


def oracle_sql():
    return {
        "op3_quality_rules": quality.OP3_SQL,
        "op5_exact_dedup": exact.OP5_SQL,
        "op7_line_dedup": lines.OP7_SQL,
        "op8_chat_formatting": chat.OP8_SQL,
        "op10_minhash_near_dedup": minhash.OP10_SQL,
        "op11_collocations": collocations.OP11_SQL,
        "op12_spelling_variants": spelling.OP12_SQL,
        "op13_license_scan": licenses.OP13_SQL,
    }
