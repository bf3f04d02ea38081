"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All but the last return the
columns of documents (others of docs are dropped); n_chars follows the text where a stage changes it. Rows of one
doc_id are one document: they stay or go together. An empty table passes every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Ids of dropped documents that a broadcast may hold; beyond, the join shuffles.
BROADCAST_IDS = 1_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, takes for good."""
    from impulsia.llm.common import table
    from impulsia.llm.nbsvm import score, train

    docs = docs.select(*COLUMNS)
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, column="_score").where("_score >= 0.5").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document of smallest id; documents without an id stay."""
    from impulsia.llm.common import written
    from impulsia.llm.jaccard_join import joined

    docs = docs.select(*COLUMNS)
    gone = written(joined(docs).where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document of smaller id has too. A document whose words all go keeps an empty text."""
    from impulsia.llm.substring_dedup import deduplicated

    cut = deduplicated(docs.select(*COLUMNS))
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast("long")
    return cut.withColumn("n_chars", n_chars).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data."""
    from impulsia.llm.pii import DEMO_KEY, KINDS, pseudonymised

    found = pseudonymised(docs.select(*COLUMNS), DEMO_KEY)
    changed = sum((F.col(f"n_{k}") for k in KINDS), F.lit(0)) > 0
    return found.withColumn("n_chars", F.when(changed, F.char_length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets."""
    import public_tokenizers

    from impulsia.llm.packing import pack

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("substring dedup", substrings),
    ("pii", personal_data),
    ("packing", packing),
]

#: A trained classifier and a tokenizer decide the rows: the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's rows written and reread before the next."""
    from impulsia.llm.common import table, written

    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k}")
    return docs
