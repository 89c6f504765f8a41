"""The queries of this subpackage, each over its whole table."""

from __future__ import annotations

from nearbox.llm import chat, decontamination, language, media, mixing, perplexity, repeats, secrets, simhash, toxicity
from nearbox.llm.common import table

QUERIES = {
    "op1_secret_scan": lambda spark, d: secrets.scan(table(spark, d, "documents")),
    "op2_perplexity": lambda spark, d: perplexity.perplexity_result(table(spark, d, "documents")),
    "op3_transport_stream": lambda spark, d: media.media_features(table(spark, d, "documents")),
    "op4_chat_collapse": lambda spark, d: chat.format_chats(table(spark, d, "conversations")),
    "op5_repeats": lambda spark, d: repeats.repeats_result(table(spark, d, "documents")),
    "op6_mix_sources": lambda spark, d: mixing.mix_result(table(spark, d, "documents")),
    "op7_simhash": lambda spark, d: simhash.simhash_result(table(spark, d, "documents")),
    "op8_language": lambda spark, d: language.language_result(table(spark, d, "documents")),
    "op9_toxicity": lambda spark, d: toxicity.toxicity_result(table(spark, d, "documents"), table(spark, d, "labels")),
    "op10_decontaminate": lambda spark, d: decontamination.overlaps(table(spark, d, "documents"), table(spark, d, "benchmark")),
}

ORACLES = {
    "op4_chat_collapse": chat.ORACLE,
    "op6_mix_sources": mixing.ORACLE,
    "op10_decontaminate": decontamination.ORACLE,
}
