"""Queries of the token operators (4 and 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm import bpe_tree, sstable
from passagework.llm.common import table

#: Vocabulary files; nothing is copied into the repository.
RANK_FILE = "byte_bpe_multi_50k.tiktoken"


def public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def bpe_round_trip(docs: DataFrame) -> DataFrame:
    """doc_id with its token count and the digests of its ids and of the decoded bytes."""
    coded = bpe_tree.encode(docs.select("doc_id", "text"), public(RANK_FILE), pattern())
    coded = coded.select("doc_id", "ids", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"))
    back = bpe_tree.decode(coded, public(RANK_FILE), pattern())
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded bytes of every document; null texts are empty."""
    return bpe_round_trip(table(spark, sf_dir, "documents"))


#: Vocabulary and end id of the token shards.
TOKENIZER_FILE = "byte_bpe_50k.json"
END_ID = 2


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read back from the shards."""
    held = sstable.write_and_read(table(spark, sf_dir, "documents"), public(TOKENIZER_FILE), END_ID)
    return held.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
