"""The corpus pipeline: documents are judged, de-duplicated, decontaminated, masked and encoded, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkfold.llm.bpe import encode_and_decode
from inkfold.llm.common import stored, table
from inkfold.llm.decontaminate import drop_contaminated
from inkfold.llm.near_dedup import drop_near_duplicates
from inkfold.llm.pii import mask_pii
from inkfold.llm.quality_model import keep_good
from inkfold.llm.queries import default_vocabulary

#: No SQL for the whole: a trained network and a tokenizer decide on rows. It is tested against a plain version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies (shingles of five words, similarity of 0.8 or more)."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return mask_pii(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids and the text these decode to."""
    return encode_and_decode(docs, default_vocabulary())


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii),
          ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; returns the rows of the last."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
