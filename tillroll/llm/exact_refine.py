"""Exact dedup by progressive refinement: length, then prefix hash, then full hash (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import cut_lineage

#: Code points that the prefix hash covers.
PREFIX = 64


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def exact_members(docs: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """(__er_full, __er_id, __er_null, __er_n, __er_keep, __er_size) of the texts that have a copy; written once.

    One row per text and doc_id, ``__er_n`` rows of which hold it. Refinement: the
    length of each text is grouped first; rows of a length that occurs twice
    show their first ``prefix`` characters; only rows whose (length, prefix
    hash) occurs twice are read in full and grouped by SHA-256. Each level
    groups narrow keys with map-side partial counts, so a group holding a
    third of the rows arrives as one row per task. Rows are known by what
    they hold, never by their place, so the scans may be split differently.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text().alias("text"))
    base = base.withColumn("__er_len", F.octet_length("text").cast("long"))
    head = F.substring("text", 1, prefix)

    lengths = cut_lineage(base.groupBy("__er_len").agg(F.count(F.lit(1)).alias("__er_n"))
                          .where("__er_n > 1").select("__er_len"))
    heads = (base.select("__er_len", head.alias("__er_head")).join(lengths, "__er_len", "left_semi")
             .select("__er_len", F.xxhash64("__er_head").alias("__er_pre")))
    prefixes = cut_lineage(heads.groupBy("__er_len", "__er_pre").agg(F.count(F.lit(1)).alias("__er_n"))
                           .where("__er_n > 1").select("__er_len", "__er_pre"))
    # an inner join, so that Spark may filter the scan at run time before any text is moved
    full = (base.withColumn("__er_pre", F.xxhash64(head)).join(prefixes, ["__er_len", "__er_pre"])
            .select(F.unhex(F.sha2("text", 256)).alias("__er_full"), *_id_key()))
    per_id = cut_lineage(full.groupBy("__er_full", "__er_id", "__er_null").agg(F.count(F.lit(1)).alias("__er_n")))
    # written, so that the join below reads two plain tables and Spark can split a large group
    groups = cut_lineage(
        per_id.groupBy("__er_full")
        .agg(F.sum("__er_n").alias("__er_size"),
             F.max(F.struct((~F.col("__er_null")).alias("some"), F.col("__er_id").alias("id"))).alias("top"))
        .where("__er_size > 1"))
    return cut_lineage(per_id.join(groups, "__er_full").select(
        "__er_full", "__er_id", "__er_null", "__er_n",
        F.when(F.col("top.some"), F.col("top.id")).alias("__er_keep"), "__er_size"))


def _id_key() -> list[Column]:
    """A doc_id as two columns that join and group without nulls."""
    own = F.col("doc_id").cast("long")
    return [F.coalesce(own, F.lit(0)).alias("__er_id"), own.isNull().alias("__er_null")]


def _is_kept() -> Column:
    """Whether a member's doc_id is the one its group keeps."""
    return F.when(F.col("__er_null"), F.col("__er_keep").isNull()).otherwise(
        F.col("__er_id").eqNullSafe(F.col("__er_keep")))


_KEY = ["__er_full", "__er_id", "__er_null"]
_ADDED = ["keep_id", "group_size", "kept"]


def exact_groups(docs: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """Add ``keep_id long, group_size long, kept boolean`` to every row of ``docs``.

    Rows are copies when their texts are identical (null counts as empty); of
    a group the row with the largest doc_id stays. Rows meet their group by
    doc_id and text hash; a caller that asks for narrow columns moves no text.

    Defined cases: an empty table gives an empty result; a null doc_id counts
    below every other id; of rows that repeat the kept doc_id and text, one
    stays (such rows, and only those, are written and numbered); extra columns
    pass through, but for columns called like the added ones, which these
    replace (names that start with ``__er_`` are reserved).
    """
    names = [c for c in docs.columns if c not in _ADDED]
    found = exact_members(docs, prefix)
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.unhex(F.sha2(_text(), 256)).alias("__er_full"), *_id_key())
    joined = rows.join(found, _KEY, "left").withColumn("__er_top", F.col("__er_size").isNull() | _is_kept())
    out = [*[F.col(f"`{c}`") for c in names],
           F.when(F.col("__er_size").isNull(), F.col("doc_id").cast("long")).otherwise(F.col("__er_keep")).alias("keep_id"),
           F.coalesce("__er_size", F.lit(1)).cast("long").alias("group_size")]
    repeats = _repeats(found)
    if repeats is None:
        return joined.select(*out, F.col("__er_top").alias("kept"))
    more = F.col("__er_top") & (F.coalesce("__er_n", F.lit(1)) > 1)
    numbered = cut_lineage(joined.where(more).select("*", F.monotonically_increasing_id().alias("__er_row")))
    first = numbered.groupBy(*_KEY).agg(F.min("__er_row").alias("__er_row")).select("__er_row", F.lit(True).alias("__er_first"))
    return (joined.where(~more).select(*out, F.col("__er_top").alias("kept"))
            .unionAll(numbered.join(first, "__er_row", "left").select(
                *out, F.coalesce("__er_first", F.lit(False)).alias("kept"))))


def _repeats(found: DataFrame) -> DataFrame | None:
    """Keys of the kept texts whose doc_id repeats them; None if there are none."""
    repeats = found.where(_is_kept() & (F.col("__er_n") > 1)).select(*_KEY)
    return None if repeats.isEmpty() else repeats


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns (see ``exact_groups`` for the rule and the defined cases)."""
    found = exact_members(docs)
    cols = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(*cols, F.unhex(F.sha2(_text(), 256)).alias("__er_full"), *_id_key())
    # written by narrow keys: of one doc_id, 60 bits of the hash tell two texts apart
    short = F.conv(F.substring(F.hex("__er_full"), 1, 15), 16, 10).cast("long").alias("__er_short")
    key = ["__er_short", "__er_id", "__er_null"]
    repeats = _repeats(found)
    gone = found.where(~_is_kept())
    gone = cut_lineage((gone if repeats is None else gone.select(*_KEY).unionAll(repeats)).select(short, *key[1:]))
    single = rows.withColumn("__er_short", short).join(gone, key, "left_anti").select(*cols)
    if repeats is None:
        return single
    # rows that repeat a kept doc_id and text: written and numbered, the first of each stays
    numbered = cut_lineage(rows.join(repeats, _KEY, "left_semi").select("*", F.monotonically_increasing_id().alias("__er_row")))
    first = numbered.groupBy(*_KEY).agg(F.min("__er_row").alias("__er_row")).select("__er_row")
    return single.unionAll(numbered.join(first, "__er_row", "left_semi").select(*cols))
