"""The registered queries of the corpus operators: thin calls that derive the contracts' columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, embeddings


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written as binary records in doc_id order and read back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    from .records import read_digests, write_records

    return read_digests(write_records(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2))


def op2_hyperminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents on 4-word shingles at 80 %: doc_id, n_shingles, component_id, kept."""
    from .hyperminhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir), shingle=4, percent=80)


def op3_ball_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products of every 20th vector: query_id, rank, vec_id, score."""
    from .balltree import top_k, vectors

    whole = vectors(embeddings(spark, sf_dir)).select("vec_id", F.transform("v", lambda x: F.floor(x * 64).cast("double")).alias("v"))
    return top_k(whole, whole.where("vec_id % 20 = 0"), k=20)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the production mixture takes: doc_id, domain, lang, source, n_tokens, epoch."""
    from .mixing import PRODUCTION, mix

    rows = mix(documents(spark, sf_dir), **PRODUCTION)
    return rows.select("doc_id", "domain", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "n_tokens", "epoch")


def op5_kneser_ney_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (and perplexity)."""
    from .kneserney import held_out, score, train

    docs = documents(spark, sf_dir)
    spec = train(docs.where(~held_out()))
    return score(docs.select("doc_id", held_out().alias("held_out"), "text"), spec, ["doc_id", "held_out"])


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document: doc_id, held_out, lang_pred, score (and cross_entropy, rejected)."""
    from .langid import fold, identify, learn

    docs = documents(spark, sf_dir)
    spec, calibration = learn(docs)
    rows = docs.select("doc_id", "text", (fold() == 0).alias("held_out"))
    return identify(rows, spec, calibration, ["doc_id", "held_out"])


def op9_flat_graph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at cosine 0.9: vec_id, n_links, component_id, kept."""
    from .flatgraph import near_vectors

    return near_vectors(embeddings(spark, sf_dir), cosine=0.9)[0]


def op10_template_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its recurring lines: doc_id, text, n_lines, n_dropped."""
    from .lines import drop_recurring_lines

    return drop_recurring_lines(documents(spark, sf_dir)).select("doc_id", "text", "n_lines", "n_dropped")


def op7_transducer_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of tokens of every document: doc_id, n_bytes, n_tokens, over_limit."""
    import public_tokenizers

    from .transducer import count_tokens

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces packed into 1024-token sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its 400-byte strings that start elsewhere too: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    from .suffixes import remove_repeats

    return remove_repeats(documents(spark, sf_dir), length=400).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_blocked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest-scoring documents of every benchmark item: item_id, rank, doc_id, score."""
    from .lexical import search

    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=10)


def op13_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all 120 orders, per source: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    from .filteraudit import audit

    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {f.__name__: f for f in (op1_token_records, op2_hyperminhash_dedup, op3_ball_tree_top_k, op4_mix_sources, op5_kneser_ney_score, op6_language_id, op7_transducer_token_counts, op8_best_fit_packing, op9_flat_graph_dedup, op10_template_line_dedup, op11_suffix_array_dedup, op12_blocked_lexical_search, op13_filter_interaction_audit)}


def queries() -> dict:
    import corpus_pipeline

    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    from .filteraudit import OP13_SQL
    from .lexical import OP12_SQL
    from .mixing import OP4_SQL

    import corpus_pipeline

    return {"op4_mix_sources": OP4_SQL, "op12_blocked_lexical_search": OP12_SQL, "op13_filter_interaction_audit": OP13_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
