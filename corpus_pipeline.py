"""A corpus from raw documents: five stages, each on all that the one before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txintel.llm import bpe, langid, mixing, neardup, quality
from txintel.llm.text import neutral
from txintel.runtime import ensure_checkpoint_dir, table

#: A document stays if its quality score is at least this.
GOOD = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that language identification rejects: those without letters (null and empty texts too), those that no
    learned language explains within its calibrated limit, and those whose best language's share is below the calibrated least.
    Repeated rows are judged alike; nulls in other columns change nothing; without labelled rows everything is rejected."""
    plain, (text, lang, doc_id), named = neutral(docs, "text", "lang", "doc_id")
    models = langid.train(plain, lang_col=lang, id_col=doc_id, text_col=text)
    return named(langid.identify(plain, models, text_col=text, keep=tuple(plain.columns)).filter(~F.col("rejected")))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier, learned from labels of documents still here, scores below GOOD. Null and
    empty texts and rows with a null id are scored like others; without labels the score is the prior, a half, and all stay."""
    plain, (text, _), named = neutral(docs, "text", "doc_id")
    model = quality.fit(quality.with_statistics(docs, ("doc_id",)), table(spark, sf_dir, "labels"))
    return named(quality.classify(plain, model, tuple(plain.columns), text_col=text).filter(F.col("score") >= GOOD))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that of least doc_id: groups are linked by Jaccard similarity 0.8 or
    more of their sets of five-word shingles, found by SimHash fingerprints. Null and empty texts are equal to each other; of
    repeated rows one stays; a row with a null id stays only where its whole group has null ids."""
    return neardup.near_dedup(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and samples documents until each source has its share of the words; documents without words go, a null source is
    a source, repeated rows are drawn each by itself."""
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix, repeats included; a null text is an empty one, of no tokens."""
    return bpe.token_digests(docs, bpe.vocabulary_path())


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("tokens", tokens),
]

#: The stages learn models; SQL can't express them. Tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what passes between them goes to the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    shared = f"{spark.sparkContext.getCheckpointDir()}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{shared}/{k}-{name}")
            docs = spark.read.parquet(f"{shared}/{k}-{name}")
    return docs
