"""Registered queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import (auction_repair, certified_pack, exact_refine, ffd_pack, mih, pii_crf, role_repair, sentence_spans,
                          spec_bpe, superminhash, sync_runs, token_files, toxic_segments)
from tillroll.llm.common import documents
from tillroll.session import ensure_checkpoint_dir, track_folder


def op1_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.drop_repeated_spans(documents(spark, sf_dir))


def op2_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role_repair.repair_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op3_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxic_segments.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxic_segments.score_documents(docs, model).select(
        F.col("doc_id").cast("long").alias("doc_id"), toxic_segments.is_held_out("doc_id").alias("held_out"),
        F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.5).cast("int").alias("predicted"),
        F.size("tox_passages").alias("n_passages"),
        F.array_join(F.transform("tox_passages", lambda p: F.concat_ws(":", p["start"], p["end"])), ",").alias("passages"))


def op4_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicate_groups(documents(spark, sf_dir))


def op5_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spec_bpe.round_trip_digests(documents(spark, sf_dir))


def op6_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.find_personal_data(documents(spark, sf_dir))


def op7_exact_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)  # taken at the scan, so the join moves no text
    docs = documents(spark, sf_dir).select("doc_id", "text", digest.alias("text_sha256"))
    return exact_refine.exact_groups(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op8_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mih.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 100 == 0)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tillroll-tokens-{uuid.uuid4().hex}"
    track_folder(spark, path)
    token_files.write_token_files(documents(spark, sf_dir), path)
    return token_files.token_digests(spark, path)


def op10_ffd_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ffd_pack.pack_documents(documents(spark, sf_dir))


def op11_certified_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return certified_pack.pack_certified(documents(spark, sf_dir)).drop("doc_tokens", "round")


def op12_sync_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync_runs.run_digests(sync_runs.periodic_runs(sync_runs.plant_periods(documents(spark, sf_dir))))


def op13_auction_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return auction_repair.conversation_report(auction_repair.repair_structure(auction_repair.damage(chats)), chats)


LLM_QUERIES = {
    "op1_sentence_spans": op1_sentence_spans,
    "op2_role_repair": op2_role_repair,
    "op3_toxic_segments": op3_toxic_segments,
    "op4_superminhash": op4_superminhash,
    "op5_speculative_bpe": op5_speculative_bpe,
    "op6_pii_crf": op6_pii_crf,
    "op7_exact_refine": op7_exact_refine,
    "op8_multi_index": op8_multi_index,
    "op9_token_files": op9_token_files,
    "op10_ffd_pack": op10_ffd_pack,
    "op11_certified_pack": op11_certified_pack,
    "op12_sync_runs": op12_sync_runs,
    "op13_auction_repair": op13_auction_repair,
}

LLM_ORACLE = {
    "op4_superminhash": r"""
        with recursive words as (
            select doc_id, regexp_extract_all(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x20\x09-\x0D]+') as w
            from documents),
        sets as (
            select doc_id, case when len(w) >= 5
                                then list_distinct(list_transform(range(0, len(w) - 4),
                                                                  lambda i: array_to_string(w[i + 1:i + 5], ' ')))
                                when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s
            from words),
        rows_ as (select doc_id, len(s) as n, unnest(s) as sh from sets),
        pairs as (
            select a.doc_id as u, b.doc_id as v, a.n as nu, b.n as nv, count(*) as c
            from rows_ a join rows_ b on a.sh = b.sh and a.doc_id <> b.doc_id
            group by a.doc_id, b.doc_id, a.n, b.n),
        links as (select u, v from pairs where 100 * c >= 75 * (nu + nv - c)),
        reach(doc_id, root) as (
            select doc_id, doc_id from sets
            union select l.v, r.root from reach r join links l on l.u = r.doc_id)
        select s.doc_id, cast(len(s.s) as bigint) as n_shingles, min(r.root) as component_id,
               s.doc_id = min(r.root) as kept
        from sets s join reach r on r.doc_id = s.doc_id group by s.doc_id, len(s.s)""",
    "op7_exact_refine": """
        select doc_id, max(doc_id) over (partition by coalesce(text, '')) as keep_id,
               count(*) over (partition by coalesce(text, '')) as group_size,
               doc_id = max(doc_id) over (partition by coalesce(text, '')) as kept,
               sha256(coalesce(text, '')) as text_sha256
        from documents""",
}
