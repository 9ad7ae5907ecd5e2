"""From raw documents to encoded training text, in five stages.

Each stage takes what the one before it kept, written as Parquet and read again. What a stage
wrote on its way is deleted once its result is written.

Any column may hold nulls; extra columns pass through all stages but the last, whatever their
names. An empty table gives an empty result. Ties are broken by id, text or hash, never by order
of arrival.
"""

from __future__ import annotations

from lodemark.llm import minhash_dedup, mixing, pii, quality_rules, sentencepiece_codec
from lodemark.llm.common import discard, scratch, scratch_path, table


def quality(spark, docs, sf_dir):
    """Documents that the base rule or the learned rules reject go; a null text has no words and goes."""
    return quality_rules.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near copies stays: that of the least id (null last), then of the least text digest.

    Documents without words are no copies of each other and all stay.
    """
    return minhash_dedup.keep_one(docs)


def personal_data(spark, docs, sf_dir):
    """Personal data is masked in the text; a null text stays null."""
    return pii.mask(docs)


def mixture(spark, docs, sf_dir):
    """Documents are taken to the target weights, some more than once; a null language or source is ``unknown``.

    Documents without tokens cost nothing and stay in the order of their hash like others.
    """
    return mixing.mixed_documents(docs)


def encoding(spark, docs, sf_dir):
    """Texts become pieces' ids; a null text has none."""
    return sentencepiece_codec.encode(docs, sentencepiece_codec.read_model())


STAGES = [
    ("quality_rules", quality),
    ("minhash_dedup", near_duplicates),
    ("pii", personal_data),
    ("source_mixing", mixture),
    ("sentencepiece", encoding),
]
#: SQL cannot express signatures, the field or the lattice; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        with scratch() as written:
            docs = stage(spark, docs, sf_dir)
            if k == len(STAGES) - 1:
                return docs
            path = scratch_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
        discard(spark, [p for p in (*written, before) if p and p != path])
        docs, before = spark.read.parquet(path), path
