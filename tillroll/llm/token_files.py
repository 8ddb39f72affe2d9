"""Token-id files: Parquet list columns with a controlled encoding, row groups and page indexes."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.common import id_text, text_slices, tokenizer_json
from tillroll.llm.wordcode import worker_coder

END_ID = 1
#: Writer settings of the format. Ids are dictionary-encoded (a row group's ids
#: are few against their count) or, with ``encoding="delta"``, delta-packed by
#: the version 2 writer. Pages of 2,000 documents keep a selective read of a
#: document's ids to a few pages; min/max of doc_id are in the page index.
ROW_GROUP_BYTES = 32 << 20
PAGE_ROWS = 2000

_FILE = T.StructType([
    T.StructField("part", T.IntegerType()),
    T.StructField("doc_id", T.LongType()),
    T.StructField("place", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
])


def tokenize_in_order(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(part, doc_id, place, n_tokens, ids): ids of each document in ascending doc_id order.

    The text is range-partitioned by doc_id (then by its hash, so a repeated
    doc_id can be split too) and sorted within partitions; the ids never cross
    a shuffle. ``place`` counts the ids before the document in its partition.
    """
    held = docs.sparkSession.sparkContext.broadcast(tokenizer_json(tokenizer_path))

    def encode(batches):
        coder = worker_coder(held.value)
        part = TaskContext.get().partitionId()
        before = 0
        for batch in batches:
            for rows in text_slices(batch):
                flat, offs = coder.encode(rows.column(1))
                n = rows.num_rows
                stops = offs[1:] + np.arange(n)
                ids = np.full(len(flat) + n, end_id, dtype=np.int32)
                own = np.ones(len(ids), dtype=bool)
                own[stops] = False
                ids[own] = flat
                offsets = np.concatenate([[0], stops + 1])
                counts = np.diff(offsets)
                place = before + offsets[:-1]
                before += int(offsets[-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, dtype=np.int32)), rows.column(0), pa.array(place),
                     pa.array(counts),
                     pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))],
                    names=["part", "doc_id", "place", "n_tokens", "ids"])

    keyed = id_text(docs).withColumn("tie", F.xxhash64("text"))
    ordered = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return ordered.select("doc_id", "text").mapInArrow(encode, _FILE)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str | None = None, encoding: str = "dictionary",
                      row_group_bytes: int = ROW_GROUP_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """Write the token table of ``docs`` to ``path``.

    Null or empty text is the end id alone; rows with a null doc_id come
    first; repeated rows are written each; an empty table writes no rows;
    extra columns are ignored.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding is dictionary or delta, not {encoding!r}")
    (tokenize_in_order(docs, tokenizer_path).write.mode("overwrite")
     .option("compression", "zstd")
     .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
     .option("parquet.writer.version", "PARQUET_1_0" if encoding == "dictionary" else "PARQUET_2_0")
     .option("parquet.block.size", row_group_bytes)
     .option("parquet.page.row.count.limit", page_rows)
     .parquet(path))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, part, place) without touching a token page.

    ``start`` is the number of ids before the document in the whole data set:
    its place in its part, plus the totals of the parts before (one row per
    written partition, so the ordered sum runs on a table of partitions).
    """
    rows = spark.read.schema(_FILE).parquet(path).select("part", "doc_id", "place", "n_tokens")
    return rows.join(_part_starts(spark, path), "part").select(
        "doc_id", (F.col("place") + F.col("before")).alias("start"), "n_tokens", "part", "place")


def _part_starts(spark: SparkSession, path: str) -> DataFrame:
    from pyspark.sql import Window

    totals = (spark.read.schema(_FILE).parquet(path).groupBy("part")
              .agg(F.sum("n_tokens").cast("long").alias("total")))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(ahead), F.lit(0)).cast("long").alias("before"))


def read_tokens(spark: SparkSession, path: str, first_doc: int | None = None,
                last_doc: int | None = None) -> DataFrame:
    """(doc_id, ids), optionally of a range of doc_ids: the range prunes row groups and pages."""
    rows = spark.read.schema(_FILE).parquet(path).select("doc_id", "ids")
    if first_doc is not None:
        rows = rows.where(F.col("doc_id") >= first_doc)
    if last_doc is not None:
        rows = rows.where(F.col("doc_id") <= last_doc)
    return rows


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files."""

    def digest(batches):
        for batch in batches:
            lists = batch.column(3)
            offs = np.asarray(lists.offsets)
            values = np.asarray(lists.values).astype("<u4", copy=False)
            crc = [zlib.crc32(values[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(offs).astype(np.int64)),
                 pa.array(crc, type=pa.int64())], names=["part", "doc_id", "place", "n_tokens", "ids_crc32"])

    rows = spark.read.schema(_FILE).parquet(path).select("part", "doc_id", "place", "ids").mapInArrow(
        digest, "part int, doc_id long, place long, n_tokens long, ids_crc32 long")
    return rows.join(_part_starts(spark, path), "part").select(
        "doc_id", (F.col("place") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
