"""A corpus pipeline made of the training-data operators: each stage reads what the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linkforge.lineage import discard, written
from linkforge.llm import bpe, line_dedup, mixing, near_dedup, toxicity
from linkforge.llm.queries import TOXIC_FROM, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that score as toxic go. A null or empty text is clean."""
    crf = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, crf, TOXIC_FROM)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: later copies of repeated line runs go out of the texts, and documents that are nothing else; n_chars follows."""
    return line_dedup.line_dedup(docs, counts=False, length_col="n_chars", keep_emptied=False)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: one document of each class of near duplicates stays, and all without words."""
    return near_dedup.near_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the words that the mix takes, a row for each document and pass over its source; documents without words have none."""
    return mixing.mix_texts(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: the id, token ids and digests of each of the mixed texts, and no other column."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.bpe(docs, path, outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near-duplicates", drop_near_copies),
    ("mixing", mix),
    ("encoding", encode),
]

#: SQL can express neither a trained sequence model nor signatures, permutations and merges.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows: doc_id, n_tokens, ids, ids_sha256, decoded_sha256 for each document and pass that the mix takes.

    Each stage is written as Parquet under the checkpoint folder and read back, so none is replayed, and deleted once
    the next one stands. Null and empty texts pass the first three stages and have no words to mix. Rows that repeat an
    id and text are one document from near-duplicates on. An empty table gives an empty result. Further columns of
    documents may have any name; all stages but the last return them.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            discard(before)
        before = docs
    return docs
