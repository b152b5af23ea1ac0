"""The corpus pipeline: quality, exact dedup, near dedup, mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``.  All but the last return
the columns of documents; rows are whole documents.  A stage names a row by its
place in the table it reads (file and row number there), beside its doc_id, so
rows without a doc_id, or that share one, are judged, dropped and repeated each
for itself.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.llm.exact_dedup import exact_dedup
from ledgerline.llm.jaccard import similarity_classes
from ledgerline.llm.mixing import mix, repeat_rows
from ledgerline.llm.packing import PRODUCTION, pack
from ledgerline.llm.quality import accepted
from ledgerline.llm.queries import vocabulary
from ledgerline.session import cut

#: A list of up to so many rows (16 bytes each) is sent to every executor.
BROADCAST_ROWS = 500_000


def _placed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row``, a hash of a row's file and number there; any other relation is written first."""
    try:
        return docs.withColumn("_row", F.xxhash64("_metadata.file_path", "_metadata.row_index"))
    except AnalysisException:
        return cut(docs, "docs").withColumn("_row", F.xxhash64("_metadata.file_path", "_metadata.row_index"))


def _drop(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """``docs`` (with ``_row``) without the rows that ``judged`` (doc_id, _row, kept) doesn't keep."""
    gone = cut(judged.filter(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("_row").alias("_r")), "dropped")
    side = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    out = docs.join(side, (F.col("_row") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti")
    return out.drop("_row")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null texts count as empty and score as such; labels that are null, or of
    other documents, teach nothing; without labels, or without documents, all
    there is stays.
    """
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest doc_id; null texts are empty and null ids come last.

    Of rows with that id one stays.  An empty table stays empty.
    """
    docs = _placed(docs)
    return _drop(docs, exact_dedup(docs, carry=("_row",)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-gram similarity of 0.8 or more, one a group: the smallest doc_id, null ids last.

    Texts without words (null ones too) stay.  An empty table stays empty.
    """
    docs = _placed(docs)
    return _drop(docs, similarity_classes(docs, carry=("_row",)))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it.

    A null source is a source; texts without words are taken as often as whole
    repetitions go; rows that repeat, or have no doc_id, are taken each.
    """
    docs = _placed(docs)
    mixed = mix(docs.select("doc_id", "text", "source", "_row"), carry=("_row",))
    return repeat_rows(docs, mixed, ("doc_id", "_row")).drop("_row")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens; a null text is its end id, rows that repeat are packed each."""
    return pack(docs, vocabulary(), PRODUCTION)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing", mixture),
    ("best-fit packing", packed),
]

#: Trained scores, MinHash and a vocabulary: SQL cannot express them; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
