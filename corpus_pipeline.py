"""From raw documents to a mix: toxic documents go, near copies go, contaminated documents go, secrets are masked, sources are mixed.

Each stage works on all rows that the one before it kept, which run() writes as Parquet and reads again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huewright.llm import decontaminate, jaccard, mixing, secrets, toxicity
from huewright.llm.common import written
from huewright.llm.queries import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the model fitted on the labels of these documents doesn't predict to be toxic.

    Null and empty texts are scored as texts without words; ids may be null (such rows are scored, but teach nothing) or repeated; an empty table gives none.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each component of links: five-word shingles, similarity of 0.8 or more.

    Rows without words or id are linked with nothing and stay, and so do all rows of a kept id; an empty table gives none.
    """
    return jaccard.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no more of the benchmark than the contamination rule allows.

    Each row is judged by its text alone: null and empty texts stay, equal texts have equal fates, and an empty table gives none.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets in their texts replaced by their kinds and n_chars following (null where the text is null).

    Repeated rows stay repeated; an empty table gives none.
    """
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each row as often (0 to 3 times) as its source's target asks for.

    Null sources are a source of their own; rows without words count no words, and rows equal in id, source and text share their copies; an empty table gives none.
    """
    return mixing.emit(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", mask_secrets),
    ("mixing", mix_sources),
]

#: The first stage is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
