"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ranklens.llm import chat, decontaminate, embeddings, htmltext, licenses, manifest, mixing, quality, simhash, spelling, tokens, toxicity, warc
from ranklens.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embeddings": lambda spark, d: embeddings.near_duplicates(read(spark, d, "embeddings")),
    "op2_chat": lambda spark, d: chat.format_chats(chat.with_control_conversation(read(spark, d, "conversations"))),
    "op3_simhash": lambda spark, d: simhash.near_duplicates(read(spark, d, "documents")),
    "op4_tokens": lambda spark, d: tokens.token_counts(read(spark, d, "documents")),
    "op5_quality": lambda spark, d: quality.quality(read(spark, d, "documents"), read(spark, d, "labels")),
    "op6_warc": lambda spark, d: warc.round_trip(read(spark, d, "pages")),
    "op7_decontaminate": lambda spark, d: decontaminate.overlap(read(spark, d, "documents"), read(spark, d, "benchmark")),
    "op8_html": lambda spark, d: htmltext.main_texts(read(spark, d, "pages")),
    "op9_mix": lambda spark, d: mixing.mix(read(spark, d, "documents")),
    "op10_toxicity": lambda spark, d: toxicity.toxicity(read(spark, d, "documents"), read(spark, d, "labels")),
    "op11_variants": lambda spark, d: spelling.variants(read(spark, d, "documents")),
    "op12_licenses": lambda spark, d: licenses.license_scan(read(spark, d, "documents")),
    "op13_manifest": lambda spark, d: manifest.manifest(read(spark, d, "documents")),
}
ORACLES: dict[str, str] = {
    "op1_embeddings": embeddings.ORACLE,
    "op2_chat": chat.ORACLE,
    "op6_warc": warc.ORACLE,
    "op7_decontaminate": decontaminate.ORACLE,
    "op9_mix": mixing.ORACLE,
    "op11_variants": spelling.ORACLE,
    "op12_licenses": licenses.ORACLE,
    "op13_manifest": manifest.ORACLE,
}
