"""The corpus pipeline: language ID, exact dedup, near dedup, mixing, SentencePiece.

Each stage takes (spark, docs, sf_dir), works on all rows it is given and returns a
DataFrame that is written as Parquet and read again as the next stage's docs. All but
the last return the columns of documents.

Null and empty texts have no letter, so the first stage rejects them; stages that are given
some all the same treat null as empty, keep it in near dedup, take it with size 0 in the mix
and give it no pieces. Null languages and sources are values like others. Repeated rows are
copies. An empty table passes through all stages as one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchbook.llm.exact_dedup import exact_dedup
from matchbook.llm.language_id import UNKNOWN, identify, sample_windows, train
from matchbook.llm.mixing import Mixture, dealt
from matchbook.llm.near_dedup import drop_near_duplicates
from matchbook.llm.pieces import encode
from matchbook.llm.queries import held_out, tokenizer_file
from matchbook.session import load, shared_dir, small_batches

#: Documents whose best language has a lower mean probability are rejected.
LEAST_SCORE = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and those of no language the model is sure of."""
    small_batches(spark)
    model = train(sample_windows(docs.where(~held_out()).select("doc_id", "text", "lang")))
    return identify(docs, model).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, that with the largest doc_id."""
    return exact_dedup(docs, keep="largest", carry=docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8."""
    small_batches(spark)
    return drop_near_duplicates(docs, words=5, percent=80).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at target weights; a document appears once for each time it is taken. Rows
    are dealt by shard and shuffled within it."""
    small_batches(spark)
    mixture = Mixture(docs)
    return dealt(mixture.rows(), mixture.shards).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_pieces and the ids of each text."""
    small_batches(spark)
    coded = encode(docs, tokenizer_file("piece_bpe_32k.model"), carry=["doc_id", "lang", "source"])
    return coded.select("doc_id", "lang", "source", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids")


STAGES = [
    ("language ID", language),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("mixing sources", mix),
    ("SentencePiece", pieces),
]

#: A trained network and piece ids are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/matchbook/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{base}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
