"""From raw documents to packed training sequences, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a frame; ``run`` writes
it as Parquet in the shared checkpoint folder and the next stage reads that.
All but the last return the columns of ``documents``, the mix also ``mix_slot``:

1. the quality network rejects documents that score below 0.7;
2. the certified quality rules reject documents that fail the base or a cutoff;
3. near copies (five-word shingles, similarity 0.8) leave one document a group;
4. the sources are mixed to their target weights: all documents are written in
   the order of the schedule, the surplus of over-represented sources last;
5. the documents are packed into sequences of 2,048 tokens, a row for each piece; the
   sequences follow the slots of the mix.

SQL can't express the network, the near copies or the packing, so there is no
oracle; tests compare the stages with brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triage.llm import mixing, near_dedup, packing, quality_model, quality_rules, scratch
from triage.llm.queries import QUALITY_CUT, tokenizer
from triage.sources.tables import read_table


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network scores 0.7 or more."""
    scored = quality_model.score(docs, read_table(spark, sf_dir, "labels"), docs.columns)
    return scored.where(F.col("score") >= QUALITY_CUT).select("row.*")


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base and the certified cutoffs."""
    return quality_rules.judge(docs, read_table(spark, sf_dir, "labels"), docs.columns).where("kept").select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.without_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the schedule, with their slot in it."""
    return mixing.mix(docs, slot="mix_slot")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of the packed documents, along the mix."""
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"), order="mix_slot")


STAGES = [
    ("quality classifier", classify_quality),
    ("quality rules", apply_rules),
    ("near copies", drop_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the packed pieces."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.saved(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
