"""From raw documents to token ids: five stages, each an operator of tarnlake.llm.

Each stage reads all that the one before it kept, as Parquet in the shared folder; a stage's folder is deleted as soon as the
next one is written, and the last at exit (`tarnlake.llm.common.clear_scratch` does so before). All stages but the last
return the documents' columns, whatever they are.

Defined cases: documents whose text is null, empty or without letters go in the first stage. Repeated rows, whether their
doc_id is the same, null or not, are one document after exact dedup. An empty table gives an empty table of the last stage's
columns. Texts of any length pass whole. Columns may have any names, those of the operators' own included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm import bagminhash, exact_dedup, langid, mixing, pieces
from tarnlake.llm.common import remove, scratch, table

MODEL = "piece_bpe_32k.model"


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, and those whose language is unclear, go."""
    model = langid.train(docs, langid.learnable(docs), model_path())
    return langid.keep_identified(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, that of the smallest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, that of the smallest doc_id."""
    return bagminhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their source's target says, in the order of their training positions."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digest of the decoded text."""
    found = pieces.encode_documents(docs, model_path())
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("SentencePiece", encode),
]

#: SQL has no language model, no sketches and no merges by score; tests/llm compares the pipeline with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents; each is written to the shared folder and read again by the next."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        folder = scratch(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before is not None:
            remove(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
