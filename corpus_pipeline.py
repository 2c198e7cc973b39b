"""The corpus pipeline: toxicity, line dedup, SimHash near-dedup, mixing and packing of documents.

Each stage takes all that the one before kept, and what it decides takes effect: rejected documents, repeated
lines and near-copies go, the mix drops and repeats documents, and the last stage returns the packed pieces. Columns that the
stages do not know, whatever their names, stay with their documents until the last. Empty tables pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import lines, mixing, packing, resemblance, toxicity
from barloom.llm.common import boxed, materialize, read, unboxed, word_count

#: SQL can express neither the models nor the packing; the stages are tested against brute force.
ORACLE_SQL = None

#: Texts of whole documents come to Python and out of Parquet in batches of about so many bytes and rows: tasks of long texts would
#: else hold 64 MB of them, and several copies, on either side. Rows of numbers are too short to reach the bytes.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.parquet.columnarReaderBatchSize": "1024"}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """``BATCHES`` hold for what is computed within the block."""
    before = {k: spark.conf.get(k, None) for k in BATCHES}
    try:
        for k, v in BATCHES.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def in_small_batches(stage: Callable) -> Callable:
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with small_batches(spark):
            return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the labelled ones among them, does not call toxic.

    Null and empty texts are scored as texts without evidence; equal texts go or stay together.
    """
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    kept = model.score(docs.select(boxed(docs, "text"), "text")).filter("predicted = 0")
    return kept.select(*(F.col(c) if c == "text" else unboxed([c])[0] for c in docs.columns))


@in_small_batches
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stand earlier; n_chars follows the text, null texts stay null with 0.

    Of equal and near lines the first by doc_id stays (null before all); rows equal in doc_id and text are treated alike.
    """
    kept = lines.drop_repeated(docs)
    return kept.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


@in_small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: links are pairs whose five-word shingles have a similarity of 0.8 at least.

    The one with the smallest doc_id stays, null before all. All texts without words, null ones too, are copies of each other.
    """
    return resemblance.keep_one(docs)


@in_small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; those without words are not taken. Null is a source of its own."""
    mixed = mixing.mix(docs.select(boxed(docs), "doc_id", "source", "text"), F.array("source"), word_count(F.col("text")))
    times = F.coalesce(F.try_divide("taken", "size"), F.lit(0)).cast("int")
    return mixed.select("_row", F.explode(F.array_repeat(F.lit(1), times)).alias("_copy")).select(*unboxed(docs.columns))


@in_small_batches
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in the sequences; a null text is an empty one. Rows that repeat are packed each."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn on the table documents, each written and read again in the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with small_batches(spark):
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
