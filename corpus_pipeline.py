"""The corpus pipeline: five stages over ``documents``, each a training-data operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.

Defined results for odd input, in every stage: an empty table gives no rows; a null
text is kept as null by the first stages, as empty once passages are cut; null and repeated ids
and repeated rows are rows of their own, until the near-copy stage keeps one row of each
group; further columns, of any name, are carried; a text of any length is read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickflow.llm import bpe, jaccard, mixing, suffixes, toxicity
from tickflow.llm.queries import token_digests, tokenizer_path
from tickflow.llm.shared import aside, written

#: Documents of this score or more are rejected, as op10 predicts.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    moved, back = aside(docs)
    text = moved.columns[docs.columns.index("text")]
    return toxicity.score_documents(moved, model, moved.columns, text).filter(f"score < {TOXIC}").select(*back)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, similarity 0.8: the document of least id stays."""
    return jaccard.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.keep_text(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_digests(bpe.encode_documents(docs, tokenizer_path()))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard", drop_near_copies),
    ("suffixes", drop_repeated_passages),
    ("mixing", mix),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained scores and components are beyond SQL; tests/llm/test_pipeline.py has the brute force.
ORACLE_SQL = None
