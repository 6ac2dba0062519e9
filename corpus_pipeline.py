"""The corpus pipeline: quality, exact copies, near copies, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and reread as the next stage's docs. All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import gracededup, mixing, nearcopies, packing, weaklabel
from lodestrata.llm.scratch import place, shielded, table, unshielded
from lodestrata.session import ready


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the weakly supervised quality scorer rejects.

    A null or empty text is scored like any very short one; whole texts are scored,
    however long. Equal texts score alike, so repeated rows stay or go together. All
    columns are returned as they are, whatever their names; an empty table stays empty.
    """
    ready(spark)
    rows = shielded(docs)
    text = place(docs, "text")
    scored = weaklabel.score(rows, weaklabel.fit(rows, text), text, out="quality_score")
    return unshielded(scored.where("quality_score >= 0.5"), docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays.

    A null text equals an empty one. A null id never wins over a number; rows that repeat
    the winning id with the same text all stay, as does a class without any id. Texts are
    compared whole. All columns are returned as they are, whatever their names; an empty
    table stays empty.
    """
    ready(spark)
    rows = shielded(docs)
    kept = gracededup.exact_dedup(rows, place(docs, "doc_id"), place(docs, "text")).where("kept")
    return unshielded(kept, docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (similarity of five-word shingles 0.8 or more) the row with the smallest doc_id stays.

    SimHash fingerprints are searched in vantage-point trees and the pairs decided by their
    shingles; pairs beyond the trees' radius are found by prefix filtering. Ids that are
    null come last, rows that tie or repeat are told apart (``nearcopies.one_of_each``).
    Texts without words, null ones among them, are copies of each other. All columns are
    returned as they are; an empty table stays empty.
    """
    ready(spark)
    return nearcopies.one_of_each(docs, words=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources to target weights draws it.

    A null source is the last one; null and empty texts have no words and are drawn with
    their block. Repeated rows are drawn one by one. All columns are returned as they are;
    an empty table stays empty.
    """
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, packed best-fit into sequences.

    A null or empty text is the single end token, a long text is cut into several pieces,
    and repeated rows are packed one by one. Only doc_id and text are read; an empty table
    gives an empty one.
    """
    ready(spark)
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]

#: The stages hold a trained scorer, SimHash links and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ready(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
