"""The corpus pipeline: five stages over documents, each on all that the one before it kept.

Cases: rows are judged one by one, so an id on several texts is several documents; rows without id are judged like
others and stay in the join, as nothing could name their group; null and empty texts are no toxic and no poor ones, are
linked with nothing, and go in the mix, which is made of words; the mix repeats rows; other columns, of whatever name,
stay in all stages but the last; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridlens.llm import mixing, ngram_join, quality, sentencepiece_codec, toxicity
from gridlens.llm.common import materialize, table

STAGES = [
    ("toxicity", toxicity.stage),
    ("quality_classifier", quality.stage),
    ("ngram_jaccard_join", ngram_join.stage),
    ("mixing_sources", mixing.stage),
    ("sentencepiece_codec", sentencepiece_codec.stage),
]

#: Learned scores and token ids can't be expressed in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
