"""The corpus pipeline: quality rules, exact and near deduplication, source mixing, tokenising.

A stage takes documents and returns documents, each from any table, in any order, written in between or
not. What a stage stages for itself stays readable with its result: it goes at the end of the
`core.scratch` block around the call, when a caller that called it within `core.holding` releases it, or
with the application. `run` releases each stage's tables once the next stage's input is on disk.

In every stage a null text counts as empty, texts are read whole, an empty table gives an empty one,
and columns of any names besides doc_id, text and source come back as they were (but for the last stage).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from echolark.core import holding, read_table, release, staged
from echolark.llm import byte_bpe, exact_dedup, mixing, near_dedup, quality_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned list keep.

    Empty texts have fewer than ten words and go; repeated rows, and rows of null ids, are judged alike.
    Without labels of both kinds the list is empty and the base rule decides alone."""
    return quality_rules.kept_documents(docs, read_table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, A-Z lower-cased: that of the largest id.

    All empty texts are equal; a null id is the smallest; of rows that repeat an id and a text one stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the smallest id: shingles of five words, similarity 0.8.

    Texts of fewer than five words are one shingle; texts without a word are linked with nothing and stay;
    a null id is the largest; of rows that repeat an id and a text one stays."""
    return near_dedup.drop_near_copies(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target shares; documents of short sources repeat, up to three times.

    Texts without a word take nothing and go; a null source is one of its own; repeated rows are documents
    of their own; the last document of a source may be cut."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document of the mix with its number of tokens and the digests of ids and decoded bytes.

    Empty texts have no ids; repeated rows and rows of null ids are encoded alike; only doc_id and source
    are kept of the other columns."""
    return byte_bpe.tokenised(docs).select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("source mixing", mix), ("byte-level BPE", tokens)]

#: Learned rules and BPE merges have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; what a stage has written goes once the next one's input is on disk."""
    docs, before = read_table(spark, sf_dir, "documents"), []
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            written: list[str] = []
            with holding(written):
                docs = staged(docs)
            release(spark, before)
            before = written
    return docs
