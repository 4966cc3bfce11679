"""The opN_ queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import decontaminate, flac, hmm, langid, packing, quality, quotes, secrets, simhash, toxicity
from paperloom.llm.common import read


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": lambda spark, d: langid.report(read(spark, d, "documents")),
    "op2_flac": lambda spark, d: flac.report(read(spark, d, "documents")),
    "op3_toxicity": lambda spark, d: toxicity.report(read(spark, d, "documents"), read(spark, d, "labels")),
    "op4_quality": lambda spark, d: quality.report(read(spark, d, "documents"), read(spark, d, "labels")),
    "op5_packing": lambda spark, d: packing.pack(read(spark, d, "documents"), tokenizer_file()),
    "op6_decontamination": lambda spark, d: decontaminate.report(read(spark, d, "documents"), read(spark, d, "benchmark")),
    "op7_quotes": lambda spark, d: quotes.conversations(read(spark, d, "conversations")),
    "op8_secrets": lambda spark, d: secrets.report(read(spark, d, "documents")),
    "op10_hmm": lambda spark, d: hmm.report(read(spark, d, "documents")),
    "op9_simhash": lambda spark, d: simhash.near_duplicates(read(spark, d, "documents")),
}
ORACLES: dict[str, str] = {"op6_decontamination": decontaminate.oracle(), "op8_secrets": secrets.oracle()}
