"""The corpus pipeline: five stages over ``documents``, each one calling an operator of ``crowdlake.llm``.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor
kept. All but the last return the columns of ``docs``. ``run`` writes each stage's rows as Parquet in the shared scratch folder and reads them back.

Defined results: null columns, empty and long texts and repeated rows are handled as the operators say. Texts without a letter are rejected by the
first stage, so an empty table, or one of such texts only, gives no rows. Extra columns pass through unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdlake.llm import hyperminhash, langid, lines, mixing, packing
from crowdlake.llm.common import documents, materialize

#: The mixture: nine tenths of the tokens, each document at most once, English at twice the weight of each other language.
MIXTURE = {"part": (9, 10), "epochs": 1, "seed": 7, "lang_weights": {"en": 2}}
SEQUENCE = 1024


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the character models accept; ``lang`` itself is only learned from."""
    spec, calibration = langid.learn(docs)
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(c).alias(n) for c, n in names.items()])
    judged = langid.identify(rows, spec, calibration, list(names.values()), text=names["text"])
    return judged.where(~F.col("rejected")).select(*[F.col(n).alias(c) for c, n in names.items()])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their recurring lines; one whose every line recurred goes. ``n_chars`` follows the text."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    done = lines.drop_recurring_lines(docs.select("doc_id", "text", *[F.col(c).alias(n) for c, n in names.items()]))
    done = done.where((F.col("n_dropped") == 0) | (F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]")) > 0))
    value = {c: F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col(n)) if c == "n_chars" else F.col(n) for c, n in names.items()}
    return done.select(*[value.get(c, F.col(c)).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one of the smallest id; of rows with one id, the first by content.

    Rows are picked by the ids that go and by those that repeat, which are few beside those that stay, so texts need no shuffle to meet them."""
    gone = hyperminhash.written_ids(hyperminhash.near_duplicates(docs, shingle=5, percent=80).where("not kept").select("doc_id"), "gone")
    several = hyperminhash.written_ids(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id"), "repeated")
    mine = docs.join(gone, "doc_id", "left_anti")  # a null id is never gone, nor repeated
    once = mine.join(several, "doc_id", "left_anti")
    first = mine.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("_row"))
    return once.select(*docs.columns).unionByName(first.select("_row.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "lang", "source")}
    rows = docs.select("doc_id", "text", "lang", "source", *[F.col(c).alias(n) for c, n in names.items()])
    return mixing.mix(rows, **MIXTURE).select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=SEQUENCE)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("best_fit_packing", best_fit_packing)]

#: Sketches, language models and tokenizers have no SQL form; the pipeline is tested stage by stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of a folder; the last stage's rows."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
