"""Training corpus in five stages: language, near duplicates, benchmark leaks, personal data, source mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on everything that the stage before kept. All but
the last return the columns of ``documents``. Stages match rows by ``doc_id``: rows without one cannot be told apart, so
they are only filtered and changed where that needs no id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlrisk.llm import decontaminate, language, mixing, near_dedup, personal_data
from urlrisk.llm.common import shared_folder, table
from urlrisk.operators.ordering import cut_lineage
from urlrisk.operators.skew import bounded_broadcast

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Results that a stage joins back by a small table if they have at most so many rows.
SMALL = 200_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; ``lang`` becomes the language that was found. Rows without an id stay as they are."""
    found = language.identify_languages(docs, docs).where("doc_id is not null")
    # equal ids with different texts: one accepted text keeps the id
    found = cut_lineage(found.groupBy("doc_id").agg(F.max(F.struct("kept", "posterior", "lang")).alias("_f")))
    other = docs.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")).distinct()
    changed = found.join(other, found["doc_id"] == other["_id"]).where(
        ~F.col("_f.kept") | ~F.col("_f.lang").eqNullSafe(F.col("_lang"))
    )
    changed = cut_lineage(changed.select("_id", "_f").distinct())
    joined = docs.join(bounded_broadcast(changed, SMALL), docs["doc_id"] == F.col("_id"), "left")
    lang = F.coalesce("_f.lang", docs["lang"])
    return joined.where("_id is null or _f.kept").select("doc_id", "text", lang.alias("lang"), "source", "n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class stays; of rows with the same id, one."""
    classes = near_dedup.near_duplicates(docs)
    gone = cut_lineage(classes.where("class_id <> doc_id").select(F.col("doc_id").alias("_id")))
    kept = docs.join(bounded_broadcast(gone, SMALL), docs["doc_id"] == F.col("_id"), "left_anti")
    again = cut_lineage(kept.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("doc_id").alias("_id")))
    again = bounded_broadcast(again, SMALL)
    single = kept.join(again, kept["doc_id"] == F.col("_id"), "left_anti")
    one = kept.join(again, kept["doc_id"] == F.col("_id"), "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("_r"))
    return single.select(*COLUMNS).unionByName(one.select("doc_id", "_r.*"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    leaks = cut_lineage(found.where(F.size("items") > 0).select(F.col("doc_id").alias("_id")).distinct())
    return docs.join(bounded_broadcast(leaks, SMALL), docs["doc_id"] == F.col("_id"), "left_anti").select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; ``n_chars`` follows. Rows without an id lose the base matches only."""
    changed = personal_data.redact_personal_data(docs).select(F.col("doc_id").alias("_id"), F.col("text").alias("_new"))
    changed = cut_lineage(changed)
    ids = bounded_broadcast(changed.select("_id"), SMALL)
    holds = docs["doc_id"] == F.col("_id")
    untouched = docs.where("doc_id is not null").join(ids, holds, "left_anti")
    touched = docs.join(ids, holds, "left_semi").drop("text", "n_chars").join(changed, F.col("doc_id") == F.col("_id"))
    nameless = docs.where("doc_id is null").withColumn("_new", personal_data.redact_base("text"))
    size = F.when(F.col("_new").eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.length("_new").cast("long"))
    return (
        untouched.select(*COLUMNS)
        .unionByName(touched.select("doc_id", F.col("_new").alias("text"), "lang", "source", F.length("_new").cast("long").alias("n_chars")))
        .unionByName(nameless.select("doc_id", F.col("_new").alias("text"), "lang", "source", size.alias("n_chars")))
    )


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many copies of each document the mix takes."""
    mixed = mixing.mix_sources(docs)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_benchmark_leaks),
    ("personal_data", redact_personal_data),
    ("mix", mix),
]

#: Trained models, sampling and verification have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    folder = shared_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
