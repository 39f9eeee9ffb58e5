"""From raw documents to packed training sequences, in stages that are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colloquy.llm import common, decontam, packing, pii, rules, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the adaptive quality rules keep, with all their columns.

    Null and empty texts have no words and go; repeated rows are judged each, and alike; null languages and sources are groups of their
    own; a metric that ties with its threshold passes; an empty table stays empty. No text is cut, however long.
    """
    return rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: that with the smallest doc_id.

    Near-duplicates differ in at most 19 bits of 128-bit fingerprints over five-word shingles, which is what a Jaccard similarity of 0.8 makes on
    average; links chain. Rows without doc_id come last in their group, and of rows that tie (repeated ones) the first stays; texts without
    words, null or empty, are one group; an empty table stays empty.
    """
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that share no window of words with a benchmark item, with all their columns.

    Null and empty texts, and documents against an empty benchmark, stay; repeated rows are judged each, and alike; a window that is in several
    items, or at several places, counts like any. Long texts are searched whole.
    """
    return decontam.remove_contaminated(docs, common.read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by the names of its kinds, and n_chars following.

    Null and empty texts stay as they are; overlapping spans become one name, that of the first, in a tie of the kind listed first; repeated rows change
    alike; other columns pass whatever their names and types.
    """
    return pii.redact_texts(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their token ids and their places in sequences.

    Null and empty texts are a piece of the end token alone; rows without doc_id, and repeated rows, are packed each; long texts are cut into pieces, none is
    dropped; for ties see ``packing``. An empty table gives no pieces.
    """
    return packing.pack(docs, keep_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("packing", best_fit_packing),
]

#: SQL can't express the hashes of the near-duplicates, the merges of the tokenizer and its packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
