"""Problem curation: ordinals, lookups, splits, samples and language mixes."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from benchloom.schemas import SOLUTIONS

SOLUTION_COLUMNS = [f.split()[0] for f in re.sub(r"<[^>]*(?:<[^>]*>)?[^>]*>", "", SOLUTIONS).split(", ")]


def shared_dir(spark) -> str:
    """The folder that all machines share: spark.checkpoint.dir. A local session may do without."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        path = "file://" + tempfile.mkdtemp(prefix="benchloom-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """df written below spark.checkpoint.dir and read again, so that later plans see the same rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/benchloom-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_ordinal(df: DataFrame, by: list[str], name: str = "idx") -> DataFrame:
    """Row positions from 0 in the order of `by`, before any filter.

    Range-partitioned: a task numbers its own range, and only one count for each range is added up,
    so no single task orders the whole table.
    """
    placed = shared_table(df.orderBy(*by).withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "ordinals")
    sizes = placed.groupBy("__part").count()
    begin = sizes.withColumn("__begin", F.sum("count").over(Window.orderBy("__part")) - F.col("count")).drop("count")
    return placed.join(F.broadcast(begin), "__part").withColumn(name, (F.col("__begin") + F.col("__at")).cast("long")).drop("__part", "__at", "__begin")


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the one with the largest order."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r"))
    return best.select(key, "r.*")


def required_lookup(rows: DataFrame, build: DataFrame, key: str) -> DataFrame:
    """Every row must find its key: a miss raises."""
    there = build.withColumn("__there", F.lit(True))
    found = rows.join(there, key, "left")
    return found.where(F.when(F.col("__there").isNull(), F.raise_error(F.concat(F.lit("no row for key "), F.col(key).cast("string")))).otherwise(F.lit(True))).drop("__there")


def draw(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def raising(df: DataFrame, wrong: Column, message: str | Column) -> DataFrame:
    """df; a row for which wrong holds is an error when it is read."""
    text = F.lit(message) if isinstance(message, str) else message
    return df.where(F.when(wrong, F.raise_error(text)).otherwise(F.lit(True)))


def sample_k(df: DataFrame, key: str, k: int, seed: int = 42, strict: bool = False) -> DataFrame:
    """k rows by the order of a keyed hash: reproducible, and a top-k, not a sort of everything.

    strict: fewer rows than k are an error.
    """
    drawn = df.orderBy(draw(F.col(key), seed), key).limit(k)
    if not strict:
        return drawn
    n = drawn.agg(F.count("*").alias("__n"))
    return raising(drawn.crossJoin(F.broadcast(n)), F.col("__n") < k, f"the pool has fewer than {k} rows").drop("__n")


def split(pool: DataFrame, key: str, k: int, wanted: DataFrame | None = None, taken: list[DataFrame] = (), forced: list | None = None, seed: int = 42, strict: bool = False) -> DataFrame:
    """Rows of pool in wanted and in none of taken: the forced ones and k drawn ones.

    strict: a missing forced key or a pool smaller than k is an error.
    """
    rows = pool if wanted is None else pool.join(wanted.select(key).distinct(), key, "left_semi")
    for t in taken:
        rows = rows.join(t.select(key), key, "left_anti")
    if not forced:
        return sample_k(rows, key, k, seed, strict)
    own = rows.where(F.col(key).isin(forced))
    if strict:
        n = own.agg(F.count("*").alias("__n"))
        own = own.join(F.broadcast(n), F.lit(True), "right")
        own = raising(own, F.col("__n") != len(forced), "not all forced rows are there").drop("__n")
    return own.unionByName(sample_k(rows.where(~F.col(key).isin(forced)), key, k, seed, strict))


def rows_of(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among keys, in its order: both lie in ranges of the key, so a row moves once for the match and the order."""
    both = rows.withColumn("__asked", F.lit(False)).unionByName(keys.select(key, F.lit(True).alias("__asked")), allowMissingColumns=True)
    there = F.max("__asked").over(Window.partitionBy(key))
    return both.repartitionByRange(key).withColumn("__there", there).where("__there AND NOT __asked").sortWithinPartitions(key).select(rows.columns)


def solutions(raw: DataFrame, ordinal_by: list[str]) -> DataFrame:
    """Raw problems as solutions: numbered before anything is dropped, then only those with a description and examples.

    An example without input or output is left out.
    """
    whole = F.filter("examples", lambda e: e["input"].isNotNull() & e["output"].isNotNull())
    # rows that will go are numbered, too, but their examples need not move
    rows = raw.withColumn("examples", F.when(F.col("description").isNotNull(), whole))
    rows = with_ordinal(rows, ordinal_by)
    names = {"id": "source_id", "generation": "response", "description": "problem_statement", "note": "problem_notes"}
    return rows.where(F.size("examples") > 0).withColumnsRenamed(names).select(*SOLUTION_COLUMNS)


def valid_slice(df: DataFrame, by: str, start: int = 0, size: int = -1, skip_invalid: bool = True) -> DataFrame:
    """Rows with more than one example, then the range of what is left."""
    return range_slice(df.where(F.size("examples") > 1) if skip_invalid else df, by, start, size)


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """df with a column `position`: its place in an order by keyed hashes."""
    return with_ordinal(df.withColumn("__draw", draw(F.col(key), seed)), ["__draw", key], "position").drop("__draw")


def epoch_batches(df: DataFrame, by: str, batch: int, epochs: int) -> DataFrame:
    """Every row once for each epoch, with epoch, batch (counted through) and previous (the batch before it)."""
    rows = with_ordinal(df, [by])
    each = F.ceil(rows.agg(F.count("*")).first()[0] / F.lit(batch)).cast("long")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(epochs - 1).cast("long"))))
    rows = rows.withColumn("batch", F.floor(F.col("idx") / batch) + F.col("epoch") * each)
    return rows.withColumn("previous", F.when(F.col("batch") > 0, F.col("batch") - 1)).drop("idx")


def is_subset(part: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """One row: whether every key of part is in whole, and how many are not."""
    return part.select(key).distinct().join(whole.select(key), key, "left_anti").agg((F.count("*") == 0).alias("is_subset"), F.count("*").alias("n_missing"))


def joined_by_position(left: DataFrame, right: DataFrame, left_by: list[str], right_by: list[str], problem: str | None = None) -> DataFrame:
    """Rows of equal position; tables of different length are an error, or reported in the column `problem`."""
    a, b = with_ordinal(left, left_by, "__row"), with_ordinal(right, right_by, "__row")
    both = a.withColumn("__a", F.lit(True)).join(b.withColumn("__b", F.lit(True)), "__row", "full")
    if problem is not None:
        said = F.when(F.col("__b").isNull(), "no right row").when(F.col("__a").isNull(), "no left row")
        return both.withColumn(problem, said).drop("__row", "__a", "__b")
    return raising(both, F.col("__a").isNull() | F.col("__b").isNull(), "the tables differ in length").drop("__row", "__a", "__b")


def language_fan_out(problems: DataFrame, langs: list[str]) -> DataFrame:
    """Every problem in every language, language-major by part_ord."""
    said = [F.struct(F.lit(i).alias("part_ord"), F.lit(x).alias("lang")) for i, x in enumerate(langs)]
    return problems.drop("lang").withColumn("l", F.explode(F.array(*said))).select("*", "l.*").drop("l")


def assign_language(problems: DataFrame, key: str, langs: list[str], seed: int = 42) -> DataFrame:
    n = F.conv(F.substring(draw(F.col(key), seed), 1, 8), 16, 10).cast("long")
    return problems.withColumn("lang", F.element_at(F.array(*map(F.lit, langs)), (n % len(langs)).cast("int") + 1))


def range_slice(df: DataFrame, by: str, start: int, size: int) -> DataFrame:
    """Rows start .. start + size - 1 in the order of by; size -1: to the end."""
    rows = df.orderBy(by).offset(start)
    return rows if size < 0 else rows.limit(size)
