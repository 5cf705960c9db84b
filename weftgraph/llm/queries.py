"""The training-data queries and their SQL twins."""

from __future__ import annotations

from . import chat, exact_dedup, langid, mixing, ngram_join, packing, quality_classifier, quality_rules, secrets, toxicity
from .common import table

QUERIES = {
    "op1_mixing": lambda spark, d: mixing.emitted(table(spark, d, "documents")),
    "op2_toxicity": lambda spark, d: toxicity.tagged(table(spark, d, "documents"), table(spark, d, "labels")),
    "op3_packing": lambda spark, d: packing.pack(table(spark, d, "documents")),
    "op4_langid": lambda spark, d: langid.identified(table(spark, d, "documents")),
    "op5_quality_rules": lambda spark, d: quality_rules.check(table(spark, d, "documents")),
    "op6_secrets": lambda spark, d: secrets.scan(table(spark, d, "documents")),
    "op7_chat": lambda spark, d: chat.formatted(table(spark, d, "conversations")),
    "op8_exact_dedup": lambda spark, d: exact_dedup.survivors(table(spark, d, "documents")),
    "op9_ngram_join": lambda spark, d: ngram_join.linked(table(spark, d, "documents")),
    "op10_quality_classifier": lambda spark, d: quality_classifier.classified(table(spark, d, "documents"), table(spark, d, "labels")),
}

ORACLES = {
    "op1_mixing": mixing.ORACLE,
    "op5_quality_rules": quality_rules.ORACLE,
    "op6_secrets": secrets.ORACLE,
    "op7_chat": chat.ORACLE,
    "op8_exact_dedup": exact_dedup.ORACLE,
    "op9_ngram_join": ngram_join.ORACLE,
}
