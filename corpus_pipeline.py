"""The corpus pipeline: toxic documents go, repeated lines go, one document of each
near-duplicate group stays, contaminated documents go, and what is left is encoded.

Each stage is written as Parquet into the shared folder and read again as the next
one's input, so that a lost executor costs a re-read of one stage; what stages write in between is removed.

Columns other than ``doc_id`` and ``text`` are carried along, whatever their names and nulls. Rows are judged by their
whole texts, however long. Each stage says what it does with null, empty and repeated ones; empty tables give none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyloom.llm import bpe, decontaminate, line_dedup, simhash, toxicity
from skyloom.llm.common import clean, materialise, read, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones, doesn't reject. Null, empty and wordless texts stay, unless
    labels of both classes can't part them from toxic ones; without labels all stay. Repeated rows share their fate."""
    model = toxicity.train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that recur in at least three documents stay in the last one only (the largest doc_id, of which null is the smallest). Null
    texts stay null, and texts of which no line stays become empty. Rows with one doc_id are one document; in the last one all copies of the line stay."""
    return line_dedup.dedup_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group (five words, similarity 0.8). Texts without words are one group. Rows
    with the doc_id that stays all stay, and a group of null ids stays whole."""
    return simhash.keep_one(docs, simhash.SIMILAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty is inside a benchmark passage. Null and wordless texts stay; null items have no
    passages; each row is judged by itself, repeated or not."""
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of what is left, a row for each row; null texts are empty."""
    return bpe.digest(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    before: list[str] = []
    for _, stage in STAGES:
        with scratch() as between:
            kept = stage(spark, docs, sf_dir)
        with scratch() as result:
            docs = materialise(kept)
        clean(spark, between + before)
        before = result
    return docs


#: The kernel model, the fingerprint groups and the encoding can't be said in SQL; the
#: tests hold each stage against a brute-force version.
ORACLE_SQL = None
