"""From raw documents to packed training sequences, as stages over the table ``documents``.

In every stage null texts count as empty, null ids and repeated rows are rows like others, an empty
table stays empty, and further columns pass through (the last stage returns places instead).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meridian.llm import packing, toxicity
from meridian.llm.common import materialize, read_table
from meridian.llm.exact_dedup import drop_exact_duplicates
from meridian.llm.mixing import select_documents
from meridian.llm.simhash import drop_near_duplicates


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go (score 0.5 or more). It learns from all labels of the input's documents; equal texts go or stay together."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (apart from the case of A-Z), the row with the largest id stays: the rule of the exact-dedup contract. Of repeated rows one stays; null ids are the smallest."""
    return drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more, transitively), the document with the smallest id stays: the one that names the group, as in the near-dedup contract. Rows with a null id stay; rows of one id stay or go together."""
    return drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One epoch of the mixture: nine tenths of the tokens, dealt by the weights of domains, languages and sources (null: names of their own). Ties in a leaf's order are broken by id and size; documents without tokens stay."""
    return select_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in sequences of 2048 tokens: one row per piece; a text without tokens is one piece, its end id. Repeated rows get places of their own."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, each written and read again before the next."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs


#: The label model, the fingerprints and the tokenizer can't be said in SQL.
ORACLE_SQL = None
