"""Registered queries over the driver's tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, embed_dedup, id_files, licenses, media, packing, simhash, substring, token_counts, toxicity
from .common import documents

#: File names of the public vocabularies.
WORD_VOCABULARY, BYTE_VOCABULARY, PIECE_VOCABULARY = "word_bpe_49k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"


def vocabulary(name: str) -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def word_vocabulary() -> str:
    return vocabulary(WORD_VOCABULARY).decode()


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), token_counts.piece_vocabulary(vocabulary(PIECE_VOCABULARY)))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.digest(documents(spark, sf_dir), byte_bpe.read_ranks(vocabulary(BYTE_VOCABULARY)), public_tokenizers.PATTERN)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(documents(spark, sf_dir))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(documents(spark, sf_dir))


def op9_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_files.digest(*id_files.write(documents(spark, sf_dir), word_vocabulary()))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.cut(documents(spark, sf_dir), word_vocabulary()))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_substring": op2_substring,
        "op3_token_counts": op3_token_counts,
        "op4_byte_bpe": op4_byte_bpe,
        "op5_toxicity": op5_toxicity,
        "op6_licenses": op6_licenses,
        "op7_embedding_dedup": op7_embedding_dedup,
        "op8_flac": op8_flac,
        "op9_huffman_ids": op9_huffman_ids,
        "op10_packing": op10_packing,
    }


_OP2_SQL = r"""WITH split AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
    windows AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i, ws FROM split WHERE len(ws) >= 50),
    keyed AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 49], ' ')) AS k FROM windows),
    firsts AS (SELECT k, min(doc_id) AS f FROM keyed GROUP BY k HAVING min(doc_id) < max(doc_id)),
    covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM keyed JOIN firsts USING (k) WHERE f < doc_id),
    placed AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM split WHERE len(ws) > 0),
    kept AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS t FROM placed ANTI JOIN covered USING (doc_id, i) GROUP BY doc_id)
    SELECT s.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM split s LEFT JOIN kept k ON k.doc_id = s.doc_id"""


def oracle_sql() -> dict[str, str]:
    """SQL for the one query that it can express; the others need hashes, tokenizers, models or media formats."""
    return {"op2_substring": _OP2_SQL}
