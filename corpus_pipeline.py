"""A training corpus from ``documents``: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bpe, common, mixing, quality, similar_sets, simhash, toxicity
from tessera.storage import materialize


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of ``sf_dir``, does not reject."""
    model = toxicity.fit(toxicity.training_rows(docs, common.read(spark, sf_dir, "labels")))
    return toxicity.keep_clean(docs, model)


def drop_low_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def drop_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that op2's fingerprints and pivots or the similarity of shingle sets link; a group is what links of both kinds connect."""
    by_bits, by_sets = simhash.near_duplicates(docs), similar_sets.near_duplicates(docs)
    return simhash.keep_one(docs, simhash.united(by_bits, by_sets))


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def tokenize(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each document of the mix, copies included: id, number of tokens, digests of ids and decoded bytes."""
    return bpe.digests(bpe.round_trip(docs, bpe.default_ranks(spark)))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("near duplicates", drop_near_copies),
    ("mixing", mix_sources),
    ("byte-level BPE", tokenize),
]

#: Neither a trained classifier nor byte-pair merges can be put in SQL.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, "stage-" + name.replace(" ", "-"))
    return docs
