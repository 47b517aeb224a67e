"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.scratch import new_path
from .conversations import damage, repair_report
from .fingerprints import edited_text, likeness, sketch, sketch_text, with_next
from .jaccard import near_duplicates
from .lines import dedup_lines
from .mixing import mix_sources
from .packing import pack_documents
from .planes import read_tokens, write_tokens
from .quality import score_quality
from .rules import judge_quality
from .search import exact_top_k
from .secrets import scan_secrets
from .spelling import spelling_variants
from .toxicity import score_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn
    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_quality")
def _quality(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, _table(spark, sf_dir, "labels")).select(
        "doc_id", "held_out", "score", "predicted")


@query("op2_exact_top_k")
def _exact_top_k(spark, sf_dir):
    return exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query("op3_mix_sources")
def _mix_sources(spark, sf_dir):
    return mix_sources(_table(spark, sf_dir, "documents"), copy_column="copy",
                       key_column="order_key")


@query("op4_ngram_jaccard")
def _ngram_jaccard(spark, sf_dir):
    return near_duplicates(_table(spark, sf_dir, "documents"), width=3, num=90, den=100)


@query("op5_fingerprints")
def _fingerprints(spark, sf_dir):
    rows = with_next(_table(spark, sf_dir, "documents")).withColumn(
        "edited", edited_text(F.col("text"), F.col("next_text")))
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited")))
    mine, edited = F.col("sketch"), F.col("edited_sketch")
    return rows.select(
        "doc_id", F.char_length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"), sketch_text(mine).alias("fingerprint"),
        sketch_text(edited).alias("edited_fingerprint"),
        likeness(mine, edited).alias("near_edited"),
        likeness(mine, F.col("next_sketch")).alias("near_next"))


@query("op6_toxicity")
def _toxicity(spark, sf_dir):
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query("op7_secrets")
def _secrets(spark, sf_dir):
    return scan_secrets(_table(spark, sf_dir, "documents"))


@query("op8_pack_documents")
def _pack_documents(spark, sf_dir):
    return pack_documents(_table(spark, sf_dir, "documents"))


@query("op9_token_planes")
def _token_planes(spark, sf_dir):
    path = new_path(spark, "tokens")
    write_tokens(_table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op10_dedup_lines")
def _dedup_lines(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, min_docs=10, min_chars=1).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op11_spelling")
def _spelling(spark, sf_dir):
    return spelling_variants(_table(spark, sf_dir, "documents"), min_chars=5, min_count=3,
                             damage_every=97, ratio=2)


@query("op12_quality_rules")
def _quality_rules(spark, sf_dir):
    return judge_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop(
        "probability")


@query("op13_conversation_repair")
def _conversation_repair(spark, sf_dir):
    talks = _table(spark, sf_dir, "conversations")
    return repair_report(talks, damage(talks))
