"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.session import cut_lineage, release, ship_package

__all__ = ["cut_lineage", "documents", "release", "ship_package", "text_slices", "tokenizer_json", "VOCAB_FILE"]

#: Name of the tokenizer file among the installed public tokenizers.
VOCAB_FILE = "word_bpe_49k.json"
#: Arrow batches are worked through in slices of at most this many bytes of text.
SLICE_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table of ``sf_dir`` and a ship of the package."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """(doc_id long, text string), null text as empty; other columns are pruned at the scan."""
    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 2,000 rows and 8 MB for this session: whole texts make 10,000 rows too large for two workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def plain_names(docs: DataFrame) -> DataFrame:
    """``docs`` under names that any later step can resolve (``text`` keeps its own); undone by ``toDF(*names)``."""
    return docs.toDF(*[c if c == "text" else f"__c{i}" for i, c in enumerate(docs.columns)])


def tokenizer_json(path: str | None = None) -> str:
    """The tokenizer file's text, read on the driver (under 2 MB) and sent to the workers."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(VOCAB_FILE)
    with open(path, encoding="utf-8") as f:
        return f.read()


def give_back() -> None:
    """Return freed memory of this worker to the system; it goes on to other tasks and stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES):
    """Cut a record batch into row slices of at most ``limit`` bytes of text (one row at least)."""
    col = batch.column(batch.schema.get_field_index("text"))
    n = len(col)
    start = 0
    while start < n:
        end, size = start, 0
        step = max(1, n - start)
        while step and end < n:
            take = min(step, n - end)
            b = col.slice(end, take).nbytes
            if size + b <= limit or (end == start and take == 1):
                end += take
                size += b
                if size > limit:
                    break
            else:
                step = take // 2
        yield batch.slice(start, end - start)
        start = end
    give_back()
