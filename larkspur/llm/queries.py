"""The corpus operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, chat, hmm, impact, infill, licenses, minhash, mixing, popcount, quality, secrets, simhash, toxicity
from .common import table

QUERIES = {
    "op1_document_fingerprints": lambda spark, d: simhash.query(table(spark, d, "documents")),
    "op2_license_scans": lambda spark, d: licenses.query(table(spark, d, "documents")),
    "op3_secret_scans": lambda spark, d: secrets.query(table(spark, d, "documents")),
    "op4_byte_bpe": lambda spark, d: bpe.query(table(spark, d, "documents")),
    "op5_toxicity": lambda spark, d: toxicity.query(table(spark, d, "documents"), table(spark, d, "labels")),
    "op6_mixing": lambda spark, d: mixing.query(table(spark, d, "documents")),
    "op7_quality_rules": lambda spark, d: quality.query(table(spark, d, "documents")),
    "op8_minhash_near_dedup": lambda spark, d: minhash.query(table(spark, d, "documents")),
    "op9_chat_formatting": lambda spark, d: chat.query(table(spark, d, "conversations")),
    "op10_lm_scoring": lambda spark, d: hmm.query(table(spark, d, "documents")),
    "op11_fill_in_middle": lambda spark, d: infill.query(table(spark, d, "documents")),
    "op12_lexical_search": lambda spark, d: impact.query(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op13_simhash_near_dedup": lambda spark, d: popcount.query(table(spark, d, "documents")),
}

ORACLES = {
    "op2_license_scans": licenses.ORACLE,
    "op7_quality_rules": quality.ORACLE,
    "op8_minhash_near_dedup": minhash.ORACLE,
    "op9_chat_formatting": chat.ORACLE,
    "op11_fill_in_middle": infill.ORACLE,
    "op12_lexical_search": impact.ORACLE,
}
