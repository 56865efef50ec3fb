"""A corpus pipeline over ``documents``: filter, deduplicate, mask and pack.

Each stage calls one operator of ``sluice.llm`` on all that the stage before it
kept; ``run`` writes each stage's rows and reads them again.  Stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import near, packing, pii, quality, repeats
from sluice.llm.common import crc_mod, persist, table, whole_row


def with_text(rows: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The columns of ``_row`` with ``text`` as the new text and its number of characters."""
    new = {"text": F.col(text), "n_chars": F.char_length(text).cast("long")}
    return rows.select(*[new.get(c, F.col("_row").getField(c)).alias(c) for c in columns])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.3; labels with crc32(doc_id) mod 5 = 0 stay unseen.

    Null and empty texts are scored like others; very long ones as a whole; repeated rows are all kept or all dropped; no
    rows or no labels keep no rows or all of them; columns of any name are kept.
    """
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0)
    held = quality.measured(docs.select(whole_row(docs).alias("_row"), "text", F.col("doc_id").alias("_doc")), "_row", "text", F.col("_doc"))
    return quality.scored(held, quality.learn(held, labels), "_row").where("score >= 0.3").select("_row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates one row: the smallest id that isn't null, and of its texts one.

    Null and empty texts are one group; repeated rows leave one; columns of any name are kept.
    """
    return near.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that long repeated substrings cover; texts may become empty.

    Null texts become empty ones; rows with null or repeated ids stay; columns of any name are kept.
    """
    return with_text(repeats.remove_repeats(docs, rows=True), docs.columns, "kept")


def without_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each span of personal data and each secret replaced by its kind.

    Null texts stay null; all rows stay; columns of any name are kept.
    """
    found = pii.find(docs.select(whole_row(docs).alias("_row"), "text"), id_col="_row", mask=True)
    return with_text(found, docs.columns, "masked")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 ids, with their ids; null and empty texts are the closing id alone."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each_group),
    ("repeats", without_repeats),
    ("private_data", without_private_data),
    ("packing", packed),
]

#: The stages train, hash and tokenise; tests hold them against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = persist(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
