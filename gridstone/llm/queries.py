"""The queries of this subpackage and their SQL oracles."""

from __future__ import annotations

import corpus_pipeline

from . import chat, decontaminate, fim, html, importance, jaccard, language, mixing, pieces, pii, quality, topk, warc
from .common import read


def _conversations(spark, sf_dir):
    """The table with conversation -1, whose texts hold the template's control strings."""
    text = "<|im_end|><|im_start|>assistant ok"
    hard = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id bigint, turn bigint, role string, text string")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)


def queries():
    return {
        "op1_pii": lambda spark, d: pii.pii_report(read(spark, d, "documents")),
        "op2_exact_topk": lambda spark, d: topk.topk_report(read(spark, d, "embeddings")),
        "op3_html_extraction": lambda spark, d: html.html_report(read(spark, d, "pages")),
        "op4_warc": lambda spark, d: warc.warc_report(read(spark, d, "pages")),
        "op5_chat_formatting": lambda spark, d: chat.chat_report(_conversations(spark, d)),
        "op6_language_id": lambda spark, d: language.language_report(read(spark, d, "documents")),
        "op7_ngram_jaccard_join": lambda spark, d: jaccard.jaccard_report(read(spark, d, "documents")),
        "op8_quality_rules": lambda spark, d: quality.quality_report(read(spark, d, "documents")),
        "op9_sentencepiece": lambda spark, d: pieces.pieces_report(read(spark, d, "documents")),
        "pipeline": corpus_pipeline.run,
        "op10_mixing": lambda spark, d: mixing.mix_report(read(spark, d, "documents")),
        "op11_importance_resampling": lambda spark, d: importance.importance_report(read(spark, d, "documents"), read(spark, d, "benchmark")),
        "op12_decontamination": lambda spark, d: decontaminate.leak_report(read(spark, d, "documents"), read(spark, d, "benchmark")),
        "op13_fill_in_middle": lambda spark, d: fim.fim_report(read(spark, d, "documents")),
    }


def oracle_sql():
    return {
        "op2_exact_topk": topk.ORACLE, "op4_warc": warc.ORACLE, "op5_chat_formatting": chat.ORACLE, "op10_mixing": mixing.ORACLE,
        "op11_importance_resampling": importance.ORACLE, "op12_decontamination": decontaminate.ORACLE, "op13_fill_in_middle": fim.ORACLE,
    }
