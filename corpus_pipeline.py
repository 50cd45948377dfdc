"""Corpus pipeline: language, near duplicates, benchmark passages, mixture, token files.

Every stage works on all documents that its predecessor kept; its result is written as
Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlens.llm import decontamination, language_id, minhash_dedup, mixing, token_files
from pairlens.llm.components import stored
from pairlens.llm.queries import END_ID, TARGETS, TOKENIZER, domains_of, table
from pairlens.llm.textbatch import quoted
from pairlens.session import fresh_path

#: No SQL: the first stage is a trained network.
ORACLE_SQL = None
#: Most copies of a document in the mixture's epoch.
REPEATS = 2.0
#: Bytes of text that the tokens stage encodes at a time: behind four other stages an executor has less memory to spare than in ``op4``.
ENCODED_BYTES = 2 << 20


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; only those without text or letters go, whatever the network's score.

    Without labelled rows there is no network, then all with letters stay.
    """
    columns = docs.columns
    model = language_id.fit(docs)
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    marked = language_id.identify(docs, model)
    return marked.filter(F.col("lang_pred") != language_id.UNDETERMINED).select(*map(quoted, columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (its smallest id), each version of it once.

    Rows of one id with different texts are versions and stay together; of rows with the same id and text
    the first by the other columns stays.  Documents without an id stay.
    """
    kept = stored(minhash_dedup.near_duplicates(docs).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct(), "kept")
    others = [F.col(quoted(c)) for c in docs.columns if c not in ("doc_id", "text")]
    first = F.row_number().over(W.partitionBy("doc_id", "text").orderBy(*(others or [F.lit(0)])))
    named = docs.join(kept, "doc_id", "left_semi").withColumn("__n", first)
    return named.filter("__n = 1").select(*map(quoted, docs.columns)).unionByName(docs.filter("doc_id IS NULL"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    hits = decontamination.scan_documents(docs, table(spark, sf_dir, "benchmark"), with_spans=False)
    return hits.filter("n_hit = 0").select(*map(quoted, docs.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights ask: each once at least and :data:`REPEATS` times at most.

    Where that bound keeps the targets out of reach, the nearest shares within it are taken and a warning says so.
    """
    labels = domains_of(table(spark, sf_dir, "labels"))
    rates = mixing.mix(docs, labels, TARGETS, least=1.0, most=REPEATS, free=True).select(F.col("doc_id").alias("__id"), F.col("copies").alias("__copies"))
    return docs.join(rates, F.col("doc_id").eqNullSafe(F.col("__id"))).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*map(quoted, docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixture; one row per document as read back from them."""
    folder = fresh_path(spark, "tokens")
    token_files.write_tokens(docs, folder, public_tokenizers.path(TOKENIZER), END_ID, slice_bytes=ENCODED_BYTES)
    return token_files.read_tokens(spark, folder)


STAGES = [
    ("language", language), ("near_duplicates", near_duplicates), ("without_benchmark", without_benchmark), ("mixture", mixture), ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


def queries():
    return {"pipeline": run}
