"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import common
from .tokens import default_path


def op1_prefix_free_parsing(spark, sf_dir):
    from .suffix_dedup import remove_repeats

    return remove_repeats(common.table(spark, sf_dir, "documents"), length=200)


def op2_string_kernel_toxicity(spark, sf_dir):
    from .toxicity import held_out, score, train

    docs = common.table(spark, sf_dir, "documents")
    model = train(docs, common.table(spark, sf_dir, "labels"), sample=2500)
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_media_columns(spark, sf_dir):
    from .media import media_columns

    out = media_columns(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "digest", "offset", "length", "width", "height", "bit_depth")


def op4_poisson_mixing(spark, sf_dir):
    from .mixing import mix

    out = mix(common.table(spark, sf_dir, "documents"), temperature=0.5, seed=7)
    return out.select("doc_id", "source", "repetitions", "copy", "mix_order", "n_chars", "text")


def op5_min_max_hash(spark, sf_dir):
    from .minhash import near_duplicates

    return near_duplicates(common.table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op6_token_files(spark, sf_dir):
    from .token_files import token_files

    out = token_files(common.table(spark, sf_dir, "documents"), tokenizer=default_path("word_bpe_49k.json"), end_id=2)
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_kd_tree_top_k(spark, sf_dir):
    from .topk import top_k

    return top_k(common.table(spark, sf_dir, "embeddings"), query_filter="vec_id % 20 = 0", k=20, scale=64)


def op8_random_field_pii(spark, sf_dir):
    from .pii import digest, find

    return digest(find(common.table(spark, sf_dir, "documents")))


def op9_diagonal_voting(spark, sf_dir):
    from .license_scan import scan

    return scan(common.table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark, sf_dir):
    from .packing import pack

    out = pack(common.table(spark, sf_dir, "documents"), tokenizer=default_path("byte_bpe_50k.json"), end_id=0, capacity=2048)
    return out.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql():
    from .mixing import mix_sql
    from .topk import top_k_sql

    return {"op4_poisson_mixing": mix_sql(columns="doc_id, source, repetitions, copy, mix_order, n_chars, text"), "op7_kd_tree_top_k": top_k_sql(k=20, scale=64, every=20)}
