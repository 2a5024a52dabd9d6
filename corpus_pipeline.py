"""A corpus pipeline of the training-data operators, each stage's rows written before the next reads them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, jaccard, mixing, quality, secrets
from tessera.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bytes of text that a file of mixed rows holds at most, about.
FILE_BYTES = 64 << 20


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base test nor a learned rule rejects.

    Null and empty texts have no words, fail the base test and go. Rows that are kept are kept as they are, repeated ones
    and those with nulls in other columns too. Rules are learned from this stage's own rows with labels; without such rows
    only the base test rejects.
    """
    rules = quality.train_rules(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "quality")
    kept = ~quality.base_failed() & (quality.verdict(rules) == 0)
    return quality.filter_rows(docs, "text", kept)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that near-duplicate links connect: the one with the least doc_id, whole.

    Repeated rows, of one doc_id and text, become one; ties of other columns go to the least values. Rows with a null doc_id stay
    only where no row with a doc_id is in their group, and then one of each text. Null and empty texts link with their like only.
    """
    return jaccard.first_of_classes(docs, "doc_id", "text").select(*COLUMNS)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked where they were found and n_chars brought up to date in texts that changed.

    Null texts stay null; every row stays, repeated ones too.
    """
    masked = docs.withColumn("masked", secrets.mask_secrets(F.col("text"), secrets.train_forest(spark), path=F.col("source")))
    changed = F.col("masked") != F.col("text")
    return masked.withColumn("n_chars", F.when(changed, F.length("masked").cast("long")).otherwise(F.col("n_chars"))).withColumn("text", F.col("masked")).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents once for each epoch of their source: each at least once, no source more than twice.

    The permutation is the order of the rows: files hold ranges of epochs and order keys, rows stand by epoch and order key
    in each, so sources are mixed alike everywhere in an epoch. Files are as many as bytes need. A null source is a
    source of its own; null and empty texts cost no budget and stay once for each whole epoch. Repeated rows are taken alike.
    """
    mixed = mixing.mix_documents(docs, "doc_id", "source", "text", max_repeats=2.0, budget="cover")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # no fewer than shuffle partitions; no source is taken more than twice
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * size // FILE_BYTES)
    return mixed.repartitionByRange(files, "epoch", "order_key").sortWithinPartitions("epoch", "order_key").select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document row, in each file's order: its token ids, and digests of them and of the bytes that they decode to.

    Null and empty texts have no ids; repeated rows have equal ones.
    """
    import public_tokenizers

    return bpe.encode_bpe(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_join),
    ("secret scans", secret_scans),
    ("source mixing", source_mixing),
    ("byte-level BPE", byte_bpe),
]

#: SQL can express neither the learned rules nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}-{name.replace(' ', '-')}")
    return docs
