"""A corpus pipeline of training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again for the next stage. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from tesserae.llm import jaccard, langid, mixing, packing, pii
from tesserae.llm.common import materialise, read, ship
from tesserae.llm.tokens import tokenizer_path


def language(spark, docs, sf_dir):
    """Documents whose language is sure; those without letters or with mixed evidence go."""
    ship(spark)
    return langid.kept(docs, host_col="source")


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of similar ones (five words, 0.8), the one of smallest doc_id."""
    ship(spark)
    return jaccard.without_copies(docs)


def personal_data(spark, docs, sf_dir):
    """Personal data replaced by its kind in brackets."""
    ship(spark)
    return pii.redact(docs)


def mixture(spark, docs, sf_dir):
    """Documents repeated or left out so that sources reach their target weights."""
    ship(spark)
    return mixing.mixed_documents(docs)


def packed(spark, docs, sf_dir):
    """Sequences of 2048 tokens."""
    ship(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("packing", packed),
]

#: Tokenizers can't be expressed in SQL; the tests run a brute-force version instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
