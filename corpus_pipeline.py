"""The corpus pipeline: documents in, a mixed, deduplicated and decontaminated reading list out.

Each stage is (name, function of (spark, docs, sf_dir)); what a stage keeps is written as parquet in
the shared folder and read again as the next one's docs. All but the last return the columns of
documents; the last returns the reads that mixing deals out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchloom.llm import common, decontamination, language_id, mixing, near_copies, suffix_dedup

#: A document whose best language stays below this share of its positions is rejected.
LEAST_SCORE = 0.3
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language the network knows; lang becomes the predicted one where it was null.

    Rejects texts that are null, have no letter, or fit no learned language. Without any labelled
    text there is nothing to learn from, and only null texts and texts without letters are rejected.
    """
    net = language_id.train(docs)
    if net is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language_id.identify(docs, net, pred="__pred", score="__score")
    kept = found.where((F.col("__pred") != "und") & (F.col("__score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "__pred")).drop("__pred", "__score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies the document with the smallest id (nulls last), of repeated rows one.

    Near copies share 0.8 or more of their 5-word shingles; op5 itself links by its contract's 3 words and 2 bits.
    """
    found = near_copies.near_copies(docs)
    first = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("f"))
    others = found.join(first, "group").where(~F.col("doc_id").eqNullSafe(F.col("f.doc_id")) | (F.col("text_hash") != F.col("f.text_hash")))
    gone = common.written(others.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct(), "copies")
    kept = docs.join(common.small(gone), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash")), "left_anti")
    # rows that agree in id and text can't be told apart above: only where there are any, they are merged
    repeated = found.groupBy("doc_id", "text_hash").count().where("count > 1")
    if repeated.isEmpty():
        return kept
    rest = F.min(F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")])).alias("r")
    return kept.groupBy("doc_id", "text").agg(rest).select("doc_id", "text", "r.*").select(docs.columns)


def cut_repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts byte strings that a document with a smaller id has; documents with nothing left go.

    A cut inside a character leaves an invalid byte, which becomes U+FFFD.
    """
    cut = suffix_dedup.dedup_suffixes(docs, keep=["lang", "source"])
    cut = cut.withColumn("text", F.make_valid_utf8(F.col("kept_text").cast("string"))).where((F.length("text") > 0) | (F.col("n_removed") == 0))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that share a window of words with a benchmark item."""
    return decontamination.clean_documents(docs, common.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The reads (doc_id, source, epoch, block, block_order, place, n_tokens) of a budget of all tokens at tempered weights."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeated_substrings),
    ("benchmark_decontamination", decontaminate),
    ("temperature_mixing", mix_sources),
]

#: The first two stages have no SQL form; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, resume: str | None = None) -> DataFrame:
    """The last stage's rows. A stage's intermediate tables are deleted once its output is stored, and so is its input.

    resume: a name for this run; a driver that is started again with it goes on after the last stage that was stored.
    """
    docs = common.table(spark, sf_dir, "documents").select(COLUMNS)
    root = f"{common.shared_dir(spark)}/pipeline-{resume or uuid.uuid4().hex}"
    paths = [f"{root}/{k}-{name}" for k, (name, _) in enumerate(STAGES)]
    done = max((k + 1 for k, path in enumerate(paths) if resume and common.complete(spark, path)), default=0)
    if done:
        docs = spark.read.parquet(paths[done - 1])
    for k in range(done, len(STAGES)):
        with common.scratch(spark):
            docs = common.stored(STAGES[k][1](spark, docs, sf_dir), paths[k])
        if k:
            common.delete(spark, paths[k - 1])
    return docs
