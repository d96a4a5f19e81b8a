"""The corpus pipeline: documents in, packed token sequences out.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as
Parquet and reads again as the next one's docs. All but the last return the columns of documents. When a stage begins, the
intermediate tables of the one before are deleted, as its result is written; unless the docs given still read them.

- Nulls: a null or empty text, or one without a letter, has no language and goes in the first stage. A null lang, source,
  n_chars or id stays what it is; a null id is not learned from, is never an earlier document, and has no smaller id.
- Repeated rows and equal texts are near-duplicates: one stays, that with the least id. Ties go to the smaller id, then to
  the row that stands first.
- Very long texts are treated whole in every stage; the last one cuts them into pieces.
- Columns beyond those of documents are kept by all stages but the last, whatever their names.
- An empty table gives an empty table in every stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import best_fit, common, icws, pivotal, suffix_dedup, zstd_langid
from flowlens.llm.queries import vocabulary
from flowlens.session import scratch_dir


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
# Where the intermediate tables of the last stage begin and end.
_LAST = [0, 0]


def _after_the_last(stage: Stage) -> Stage:
    """The stage, once the intermediate tables of the one before are deleted."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not common.reads(docs, *_LAST):
            common.release(spark, *_LAST)
        _LAST[0] = common.made()
        out = stage(spark, docs, sf_dir)
        _LAST[1] = common.made()
        return out

    return run_stage


@_after_the_last
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by a margin; the rest go."""
    return zstd_langid.accepted(docs)


@_after_the_last
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least id."""
    return icws.one_of_each(docs)


@_after_the_last
def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 13-word windows that a document with a smaller id has; emptied ones go."""
    left = suffix_dedup.deduplicate(docs)
    return left.withColumn("n_chars", F.length("text").cast("long"))


@_after_the_last
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return pivotal.repeated(docs)


@_after_the_last
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4096 tokens."""
    return best_fit.pack(docs, vocabulary(), size=4096, end_id=1).drop("ids")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_spans", repeated_spans),
    ("mixture", mixture),
    ("packing", packing),
]

# Learned dictionaries, weighted samples and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_dir(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
