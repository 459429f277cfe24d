"""Corpus pipeline: five stages from raw documents to clean text that a tokenizer can take.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the columns of ``documents``;
the last adds the token ids. ``run`` writes each stage as Parquet below the shared checkpoint folder and reads it again.

Extra columns are kept by all stages, also those named like something a stage makes; rows may repeat, and every column
may be null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeframe.llm import common, decontaminate, language_id, near_copies, piece_codec, secret_scan


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without letters or with too narrow a margin go.

    Null, empty and letterless texts go; a tie of two languages has no margin and goes; rows without a label are judged
    like others; repeated rows are judged one by one; without any labelled row all go; an empty table stays empty.
    """
    own = {c: f"__{c}" for c in docs.columns if c in ("lang_pred", "score", "accepted")}
    found = language_id.identify(docs.withColumnsRenamed(own), language_id.learn(docs.filter(language_id.training_rows()))).filter("accepted")
    return found.select([F.col(own.get(c, c)).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup at five-word similarity 0.8: of each group the row with the smallest id stays.

    Null and empty texts are one group; of rows with one id one stays; rows without an id stay, since no group can be
    named by them; texts of any length count whole; an empty table stays empty.
    """
    return near_copies.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark item go.

    Null and empty texts hold none and stay; repeated rows stay or go together; without items all stay; an empty table
    stays empty.
    """
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: secrets become a mark, no document goes, and ``n_chars`` is counted anew.

    Null texts stay null (with a null count), empty ones empty; overlapping secrets become one mark; a table without
    credentials is masked by the base patterns alone; an empty table stays empty.
    """
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece: the ids of each text and their number, in columns ``ids`` and ``n_tokens`` at the end.

    Null and empty texts have no ids and 0 tokens; columns of these names are replaced; repeated rows are encoded one by
    one; an empty table stays empty.
    """
    return piece_codec.encode(docs).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("secret_scan", mask_secrets),
    ("sentencepiece", encode_pieces),
]

#: Compression, fingerprints and automata have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What the last stage wrote stays; the tables between the stages are removed."""
    docs = common.table(spark, sf_dir, "documents")
    with common.Scratch(spark) as between:
        for name, stage in STAGES[:-1]:
            docs = between.keep(stage(spark, docs, sf_dir), name)
        last, stage = STAGES[-1]
        return common.Scratch(spark).keep(stage(spark, docs, sf_dir), last)
