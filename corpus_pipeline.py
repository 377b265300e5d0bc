"""From raw documents to packed training sequences.

``STAGES`` are applied in order; each reads what the one before kept, as Parquet.

Of every stage: a null text is read as an empty one and stays null where its row stays; a null ``doc_id``
is an id like any other; repeated rows are rows of their own (near_dedup keeps one); an empty table gives
no rows; other columns, whatever their names, come back as they were, except from the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.common import materialize, scratch, table
from quillspark.llm.decontaminate import drop_leaks
from quillspark.llm.near_copies import keep_one
from quillspark.llm.packing import pack, tokenized_pieces
from quillspark.llm.quality import keep_good
from quillspark.llm.secrets import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: those whose rule-ensemble score is below the operator's threshold.

    Without labels of both classes the score is the smoothed base rate, one for all rows.
    """
    return keep_good(spark, docs, sf_dir)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id (of equal ones, the first stored).

    Near copies are linked by SimHash fingerprints of five-word shingles (3 bits) or by a Jaccard index of
    0.8 or more of those shingles.  All texts without words are one group.
    """
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, copied or edited, go.

    Null and empty texts and items match nothing; every row of a repeated text goes.
    """
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; every document stays, and ``n_chars`` counts anew (null for a null text)."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of what is left, as pieces placed in sequences of at most 4096.

    Ties of length are packed in the order of their rows; a null text is the end id alone.
    """
    return pack(materialize(tokenized_pieces(docs), "pieces"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", secrets), ("packing", packing)]
#: SQL cannot express the classifier's fit, MinHash components, alignment or best-fit packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
