"""The corpus pipeline: language ID, near-duplicates, repeated passages, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import _common, langid, minhash, mixing, packing, suffix_dedup

STAGES = [
    ("language_id", langid.keep_identified),
    ("minhash_near_dedup", minhash.keep_one_of_each),
    ("suffix_array_dedup", suffix_dedup.keep_rest),
    ("mixing", mixing.mixed_documents),
    ("packing", packing.packed_documents),
]

#: Language ID, the banding and the tokenizer aren't SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _common.table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = _common.settle(stage(spark, docs, sf_dir), name)
        if before is not None:  # nothing reads the stage before any more
            _common.forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
