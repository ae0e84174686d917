"""The corpus pipeline: STAGES in order, each one of the training-data operators.

Each stage gets all that its predecessor kept, read again from Parquet in the shared
folder, and what it decides takes effect:

1. language ID: documents whose language cannot be told go;
2. line dedup: later copies of runs of lines go, and documents of which nothing is left;
3. MinHash near-dedup: of each group the document with the smallest id stays;
4. benchmark decontamination: documents that overlap with a benchmark item go;
5. best-fit packing: what is left is tokenized and packed into sequences.

The first four return the columns of ``documents``. Rows that repeat id and text are one
document to stages 2 and 3. Nulls, empty and very long texts, ties and empty tables have
the results that the operators define; columns beyond those of ``documents`` pass through
the first four stages.

The stages work on batches of texts that are small enough for the workers of all cores to
fit beside each other: they set ``BATCH_CONF`` for the session unless it is set.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from recordlink.llm.common import table, written
from recordlink.llm.decontaminate import drop_contaminated
from recordlink.llm.language import keep_identified
from recordlink.llm.line_dedup import drop_repeated_lines
from recordlink.llm.minhash import drop_near_duplicates
from recordlink.llm.packing import pack_documents
from recordlink.session import small_batches

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("language_id", in_small_batches(keep_identified)),
    ("line_dedup", in_small_batches(drop_repeated_lines)),
    ("minhash_near_dedup", in_small_batches(drop_near_duplicates)),
    ("benchmark_decontamination", in_small_batches(drop_contaminated)),
    ("best_fit_packing", in_small_batches(pack_documents)),
]

# the learned model, the signatures and the packing are beyond SQL; tests/llm holds each
# stage and the whole against plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what the stages keep of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
