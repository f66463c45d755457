"""A training corpus from documents: the stages, each over all rows that the one before kept.

Defined results, in all stages: a null or empty text has no letters and goes at the first; no rows give no rows; repeated rows are
copies, of which one stays; ties are settled as the operators say; columns besides doc_id, text, lang and source, whatever their names, are carried along
up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import decontamination, language, mixing, ngram_join, token_files
from helixframe.llm.shared import documents, stash

#: No SQL form: several stages cannot be expressed in it; the tests hold a brute-force version.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or far from every language go; the profiles learn from all documents with a lang."""
    found = language.identify(docs, language.profiles(docs), keep=docs.columns)
    guess, score = (F.col(c) for c in found.columns[len(docs.columns) :][:2])
    return found.where(~language.rejected(guess, score)).select(*(F.col(f"`{c}`") for c in docs.columns))


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document of least id stays."""
    return ngram_join.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of any benchmark item go."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources at their target weights: copies and pieces of documents, as taken."""
    return mixing.mixed_documents(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token ids in binary files, and where in them each document lies."""
    return token_files.encoded(docs)


STAGES = [
    ("language", identify_language),
    ("near-copies", join_near_copies),
    ("decontaminate", decontaminate),
    ("mix", mix_sources),
    ("token-ids", write_token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written and read again before the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
