"""The corpus pipeline: documents in, tokenized training mix out.

``STAGES`` in order: toxic documents go, one document of each SimHash group
stays, the sources are mixed to their target weights (a document may appear
up to three times), and the rest is encoded with SentencePiece.  Every stage
but the last returns the columns of ``documents``; ``run`` writes each stage's
rows as Parquet into the shared folder and reads them back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tally.llm import mixing, sentencepiece, simhash, toxicity
from tally.llm.shared import documents, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scoring under the toxicity threshold; the grammar is learned
    from the labelled documents among ``docs``."""
    return toxicity.keep_clean(docs, documents(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate group."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_rows(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ``token_ids`` and the text these decode to."""
    import public_tokenizers

    return sentencepiece.with_pieces(docs, public_tokenizers.path(sentencepiece.MODEL))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", tokenize),
]

#: No SQL: learning the grammar, SimHash and Viterbi are beyond it; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
