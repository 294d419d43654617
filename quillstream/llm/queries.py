"""The corpus queries: thin digests of what the operators return, each over a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import attention, bpe, lattice, lines, maxscore, minhash, mixing, negatives, pii, secrets, token_counts, toxicity, variants
from quillstream.llm.shared import saved


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents: five words a shingle, similarity of 0.75."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.digest_columns(pii.detect(_table(spark, sf_dir, "documents")))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document, with the first line that it repeats within two edits."""
    return lines.repeated_lines(_table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, through a ledger that starts empty."""
    return secrets.digest_columns(secrets.scan(_table(spark, sf_dir, "documents")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels outside the held-out fold."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, one source each."""
    return mixing.digest_columns(mixing.mix(_table(spark, sf_dir, "documents"), F.array("source")))


def op7_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for every 50th vector."""
    vectors = maxscore.integer_vectors(_table(spark, sf_dir, "embeddings"))
    return maxscore.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the 50k byte-level vocabulary, and digests of the round trip."""
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document by the 49k word vocabulary, through a cache that starts empty."""
    counted = token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op10_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors at a cosine of 0.95."""
    return lattice.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op11_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document by a causal self-attention model, learnt from the training fold."""
    return attention.score_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives for every 50th vector."""
    rows = saved(negatives.labelled_vectors(_table(spark, sf_dir, "embeddings")), "vectors")
    return negatives.hard_negatives(rows, rows.where(F.col("vec_id") % 50 == 0))


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, the commoner form of each, and the root that forms lead to."""
    return variants.variants(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_pii": op2_pii,
    "op3_lines": op3_lines,
    "op4_secrets": op4_secrets,
    "op5_toxicity": op5_toxicity,
    "op6_mixing": op6_mixing,
    "op7_maxscore": op7_maxscore,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_token_counts": op9_token_counts,
    "op10_lattice": op10_lattice,
    "op11_attention": op11_attention,
    "op12_negatives": op12_negatives,
    "op13_variants": op13_variants,
}
ORACLE_SQL = {"op6_mixing": mixing.ORACLE, "op7_maxscore": maxscore.ORACLE, "op12_negatives": negatives.ORACLE}
